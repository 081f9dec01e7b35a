"""``python -m strandmill index FASTA INDEX | compress FASTQ INDEX ARCHIVE | decompress ARCHIVE INDEX FASTQ``"""

from __future__ import annotations

import sys


def main(args: list[str], spark=None) -> int:
    counts = {"index": 2, "compress": 3, "decompress": 3}
    if not args or len(args) - 1 != counts.get(args[0]):
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from . import archive, shared
    from .operators import align, blocked, index
    from .sources import fasta, fastq

    spark = spark or SparkSession.builder.appName("strandmill").getOrCreate()
    spark.dataSource.register(fastq.FastqSource)
    spark.dataSource.register(fasta.FastaSource)
    if args[0] == "index":
        text = shared.materialize(blocked.normalised(spark.read.format("fasta").load(args[1])), "text")
        if blocked.length(text) > align.MOST_BASES:  # too large to send to tasks
            blocked.build(text, args[2])
        else:
            fasta.build_index(index.joined(text), args[2])
    elif args[0] == "compress":
        reads = fastq.numbered(spark.read.format("fastq").load(args[1]))
        ref, sa = fasta.stored(spark, args[2])
        archive.compress(reads, ref, args[3], sa)
    else:
        fastq.write(archive.decompress(spark, args[1], fasta.stored(spark, args[2])[0]), args[3])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
