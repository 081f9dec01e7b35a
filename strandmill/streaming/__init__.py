"""The batch operators over streams of read batches."""
