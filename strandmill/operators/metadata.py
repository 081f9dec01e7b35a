"""Read headers as typed fields: tokens, profiles, type decisions, dictionaries, codes and their sizes.

All inputs have read_id (0-based and contiguous where chunks are wanted) and meta.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as fn
from ..functions import packed

#: Bits of a stream's header: mark, number of fields, entries, number of separators; then 3 a separator.
HEADER_BITS = 32 + 8 + 24 + 8
#: Values of all dictionaries of a schema up to which they are sent to every task; beyond that Spark chooses the join.
FEW = 100_000


def token_table(reads: DataFrame) -> DataFrame:
    """(read_id, field, value), fields counted from 0."""
    return reads.select("read_id", F.posexplode(fn.tokens(F.col("meta"))).alias("field", "value"))


def separator_counts(reads: DataFrame) -> DataFrame:
    """(separators, n_fields, n): how many headers have which separators in order."""
    sep = fn.separators(F.col("meta"))
    return reads.select(sep.alias("separators")).groupBy("separators").agg(F.count(F.lit(1)).alias("n")).select("separators", (F.length("separators") + 1).alias("n_fields"), "n")


def separator_codes(reads: DataFrame) -> DataFrame:
    """(position, separator, code) of the header with the smallest read_id."""
    first = reads.agg(F.min_by(fn.separators(F.col("meta")), "read_id").alias("s"))
    chars = first.where(F.length("s") > 0).select(F.posexplode(F.split("s", "")).alias("position", "separator"))
    return chars.where(F.length("separator") > 0).select("position", "separator", fn.separator_code(F.col("separator")).alias("code"))


def profile(reads: DataFrame, chunks: int = 16, compat: bool = False) -> DataFrame:
    """Per chunk and field: rows, distinct values, whether numeric, extremes and longest value.

    The counts combine before the shuffle; distinct values are grouped first, so a field
    with one value is one row a task.
    """
    n = reads.select(F.count(F.lit(1)).alias("entries"))
    chunked = reads.join(F.broadcast(n)).select("read_id", "meta", fn.chunk_of(F.col("read_id"), F.col("entries"), chunks).alias("chunk"))  # one row
    values = chunked.select("chunk", F.posexplode(fn.tokens(F.col("meta"))).alias("field", "value")).groupBy("chunk", "field", "value").agg(F.count(F.lit(1)).alias("c"))
    number = F.when(fn.is_numeric(F.col("value"), compat), F.expr("try_cast(value as bigint)"))
    return values.groupBy("chunk", "field").agg(
        F.sum("c").cast("long").alias("n"),
        F.count(F.lit(1)).alias("ndv"),
        F.min(fn.is_numeric(F.col("value"), compat)).alias("numeric"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
        F.max(F.length("value")).alias("longest"),
        F.min("value").alias("first"),
        F.max("value").alias("last"),
    )


def types_compat(reads: DataFrame, chunks: int = 16) -> DataFrame:
    """(field, type) by the merge of chunk decisions: constant, counting, numeric or text.

    A chunk whose numbers span as many values as it has rows is counting, without a look at
    their order; chunks that are constant but differ count as numeric or text.
    """
    p = profile(reads, chunks, compat=True)
    kind = F.when(F.col("ndv") == 1, F.when(F.col("numeric"), 1).otherwise(2)).when(F.col("numeric") & (F.col("high") - F.col("low") + 1 == F.col("n")), 0).when(F.col("numeric"), 1).otherwise(2)
    merged = p.withColumn("k", kind).groupBy("field").agg(F.max("k").alias("k"), F.max("ndv").alias("m"), F.min("first").alias("a"), F.max("last").alias("b"))
    constant = (F.col("m") == 1) & (F.col("a") == F.col("b"))
    return merged.select("field", F.when(constant, "CONST").when(F.col("k") == 0, "AUTOINC").when(F.col("k") == 1, "NUMERIC").otherwise("ALPHA").alias("type"))


def schema(reads: DataFrame, rule: int = 100) -> DataFrame:
    """(field, type, ndv, n, low, high, longest, width, mapped, constant): what encoding needs of each field.

    Counting fields are those whose value is the smallest one plus the row's number, checked
    row by row. ``mapped`` says that a dictionary pays: fewer than one distinct value
    in ``rule`` rows. Widths are bits a row. Constants are told by comparison with the first
    read, so one small aggregate decides all types; only text fields have their
    distinct values counted (``ndv`` is null for numeric fields).
    """
    tokens = token_table(reads)
    head = reads.agg(F.min_by("meta", "read_id").alias("meta")).where("meta is not null").select(F.posexplode(fn.tokens(F.col("meta"))).alias("f", "v0"))
    numeric = fn.is_numeric(F.col("value"))
    number = F.when(numeric, F.expr("try_cast(value as bigint)"))
    apart = number - F.col("read_id")  # the same for all rows of a counting field
    rows = tokens.join(F.broadcast(head), F.col("field") == F.col("f"), "left")  # a row a field
    whole = rows.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.coalesce(F.col("value") == F.col("v0"), F.lit(False))).alias("same"),
        F.min(numeric).alias("numeric"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
        F.max(F.octet_length("value")).alias("longest"),
        (F.min(apart) == F.max(apart)).alias("counts"),
    )
    kind = F.when(F.col("same"), "CONST").when(F.col("numeric") & F.col("counts"), "AUTOINC").when(F.col("numeric"), "NUMERIC").otherwise("ALPHA")
    typed = whole.withColumn("type", kind).join(F.broadcast(head), F.col("field") == F.col("f"), "left")
    texts = typed.where("type = 'ALPHA'").select(F.col("field").alias("t"))
    distinct = tokens.join(F.broadcast(texts), F.col("field") == F.col("t")).groupBy("field", "value").agg(F.count(F.lit(1)).alias("c"))
    counted = distinct.groupBy(F.col("field").alias("d")).agg(F.count(F.lit(1)).alias("distinct"))
    full = typed.join(F.broadcast(counted), F.col("field") == F.col("d"), "left")
    ndv = F.when(F.col("type") == "CONST", F.lit(1).cast("long")).when(F.col("type") == "AUTOINC", F.col("n")).when(F.col("type") == "ALPHA", F.col("distinct"))
    mapped = (F.col("type") == "ALPHA") & (F.col("ndv") * rule < F.col("n"))
    width = F.when(F.col("type").isin("CONST", "AUTOINC"), F.lit(0)).when(F.col("type") == "NUMERIC", fn.digits(F.col("high") + 1, 2)).when(F.col("mapped"), fn.digits(F.col("ndv"), 2)).otherwise(F.col("longest") * 8)
    return full.withColumn("ndv", ndv).withColumn("mapped", F.coalesce(mapped, F.lit(False))).withColumn("width", width.cast("long")).select("field", "type", "ndv", "n", "low", "high", "longest", "width", "mapped", F.when(F.col("type") == "CONST", F.col("v0")).alias("constant"))


def frozen(kinds: DataFrame) -> DataFrame:
    """A schema as literal rows, one a field, so that what uses it several times doesn't infer it again."""
    return kinds.sparkSession.createDataFrame(kinds.collect(), kinds.schema)


def dictionary(reads: DataFrame, kinds: DataFrame | None = None, used: bool = False) -> DataFrame:
    """(field, value, code): codes of text fields in byte order of their values. With ``used``, only of fields that are mapped, whose
    values are few; a field of free text has as many values as rows, and nothing needs their codes.
    """
    kinds = schema(reads) if kinds is None else kinds
    texts = kinds.where((F.col("type") == "ALPHA") & (F.col("mapped") | F.lit(not used))).select(F.col("field").alias("f"))
    distinct = token_table(reads).join(F.broadcast(texts), F.col("field") == F.col("f")).select("field", "value").distinct()  # one row a field
    return distinct.withColumn("code", F.row_number().over(Window.partitionBy("field").orderBy("value")) - 1)


def dictionary_rule(values: DataFrame, columns: list[str], rule: int = 100) -> DataFrame:
    """(column, ndv, n, mapped): whether a dictionary pays for each column, in one pass over the table."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    counts = values.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("c"))
    whole = counts.groupBy("column").agg(F.count(F.lit(1)).alias("ndv"), F.sum("c").cast("long").alias("n"))
    return whole.select("column", "ndv", "n", (F.col("ndv") * rule < F.col("n")).alias("mapped"))


def _words(reads: DataFrame, kinds: DataFrame, listed: list) -> Callable[[int, str, str], DataFrame]:
    """The dictionary of one field as two named columns. Up to FEW values in all it is made once and sent to every task."""
    words = dictionary(reads, kinds, used=True)
    few = sum(k.ndv for k in listed if k.mapped) <= FEW
    if few and any(k.mapped for k in listed):
        words = frozen(words)

    def of(field: int, value: str, code: str) -> DataFrame:
        one = words.where(F.col("field") == field).select(F.col("value").alias(value), F.col("code").alias(code))
        return F.broadcast(one) if few else one

    return of


def _field_bits(reads: DataFrame, listed: list, words) -> tuple[DataFrame, list[Column]]:
    """Rows of headers, and a column for each field with its bits, null where a header lacks the field. Fields stay in their row:
    only dictionaries are joined.
    """
    rows = reads.where("meta is not null").select("read_id", "meta", fn.tokens(F.col("meta")).alias("_tokens"))
    out = []
    for k in listed:
        value, width = F.get("_tokens", F.lit(k.field)), F.lit(int(k.width or 0))
        if k.type in ("CONST", "AUTOINC"):
            bits = F.lit("")
        elif k.type == "NUMERIC":
            bits = fn.bits(value.try_cast("bigint"), width)
        elif k.mapped:
            rows = rows.join(words(k.field, f"_word{k.field}", f"_code{k.field}"), value == F.col(f"_word{k.field}"), "left")
            bits = fn.bits(F.col(f"_code{k.field}"), width)
        else:
            bits = F.rpad(packed.unpack(F.encode(value, "UTF-8")), width, "0")
        out.append(F.when(value.isNotNull(), bits))
    return rows, out


def row_codes(reads: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """(read_id, bits): a header's fields in order, each as a string of binary digits. Null headers have no row.

    Constant and counting fields take no bits; text without a dictionary is spelled in UTF-8, 8 bits
    a byte, padded with zeros.
    """
    kinds = frozen(schema(reads)) if kinds is None else kinds
    listed = kinds.orderBy("field").collect()  # a row a field
    rows, bits = _field_bits(reads, listed, _words(reads, kinds, listed))
    return rows.select("read_id", F.concat_ws("", *bits).alias("bits"))


def decoded(reads: DataFrame) -> DataFrame:
    """(read_id, meta): headers put together again from their codes and separators, inside their rows."""
    kinds = frozen(schema(reads))
    listed = kinds.orderBy("field").collect()  # a row a field
    words = _words(reads, kinds, listed)
    rows, bits = _field_bits(reads, listed, words)
    first = reads.agg(F.min("read_id").alias("_least"))
    coded = rows.select("read_id", F.concat(F.lit("@"), fn.separators(F.col("meta"))).alias("_marks"), *(b.alias(f"_bits{k.field}") for k, b in zip(listed, bits))).join(F.broadcast(first))  # one row
    parts = []
    for k in listed:
        code = F.col(f"_bits{k.field}")
        if k.type == "CONST":
            value = F.lit(k.constant)
        elif k.type == "AUTOINC":
            value = (F.lit(k.low) + F.col("read_id") - F.col("_least")).cast("string")
        elif k.type == "NUMERIC":
            value = fn.from_bits(code).cast("string")
        elif k.mapped:
            coded = coded.join(words(k.field, f"_word{k.field}", f"_code{k.field}"), fn.from_bits(code) == F.col(f"_code{k.field}"), "left")
            value = F.col(f"_word{k.field}")
        else:
            value = F.replace(F.decode(packed.pack(code), "UTF-8"), F.chr(F.lit(0)), F.lit(""))
        parts.append(F.when(code.isNotNull(), F.concat(F.substr(F.col("_marks"), F.lit(k.field + 1), F.lit(1)), value)))
    return coded.select("read_id", F.concat_ws("", *parts).alias("meta"))


def stream_size(reads: DataFrame) -> DataFrame:
    """(n_fields, header_bits, descriptor_bits, body_bits, bytes) of the packed stream."""
    kinds = frozen(schema(reads))
    words = dictionary(reads, kinds, used=True).groupBy(F.col("field").alias("f")).agg(F.sum(F.length("value") + 1).alias("chars"))
    descriptor = (
        F.when(F.col("type") == "CONST", 4 + 12 + 8 * F.length("constant"))
        .when(F.col("type") == "AUTOINC", F.lit(4 + 28))
        .when(F.col("type") == "NUMERIC", F.lit(4 + 12))
        .when(F.col("mapped"), 4 + 12 + 8 * F.col("chars"))
        .otherwise(F.lit(4 + 12))
    )
    sized = kinds.join(words, F.col("field") == F.col("f"), "left").select("width", "n", descriptor.alias("d"))
    whole = sized.agg(F.count(F.lit(1)).alias("n_fields"), F.sum("d").cast("long").alias("descriptor_bits"), F.sum(F.col("width") * F.col("n")).cast("long").alias("body_bits"))
    header = F.lit(HEADER_BITS) + 3 * (F.col("n_fields") - 1)
    return whole.select("n_fields", header.cast("long").alias("header_bits"), "descriptor_bits", "body_bits", F.ceil((header + F.col("descriptor_bits") + F.col("body_bits")) / 8).cast("long").alias("bytes"))


def violations(reads: DataFrame, kinds: DataFrame, words: DataFrame) -> DataFrame:
    """(field, reason, n): values that a schema and dictionary learned from other reads can't encode."""
    t = token_table(reads).join(F.broadcast(kinds.withColumnRenamed("field", "f")), F.col("field") == F.col("f"))
    t = t.join(words.select(F.col("field").alias("df"), F.col("value").alias("dv")), (F.col("field") == F.col("df")) & (F.col("value") == F.col("dv")), "left")
    numeric = fn.is_numeric(F.col("value"))
    number = F.expr("try_cast(value as bigint)")
    reason = (
        F.when((F.col("type") == "CONST") & (F.col("value") != F.col("constant")), "constant")
        .when((F.col("type") == "NUMERIC") & ~numeric, "not a number")
        .when((F.col("type") == "NUMERIC") & (fn.digits(number, 2) > F.col("width")), "overflow")
        .when((F.col("type") == "ALPHA") & F.col("mapped") & F.col("dv").isNull(), "not in dictionary")
        .when((F.col("type") == "ALPHA") & ~F.col("mapped") & (F.octet_length("value") * 8 > F.col("width")), "overflow")
    )
    return t.select("field", reason.alias("reason")).where("reason is not null").groupBy("field", "reason").agg(F.count(F.lit(1)).alias("n"))


def deltas(rows: DataFrame, key: str, value: str, group: Column) -> DataFrame:
    """(key, group, value, delta): each value less the one before it in its group; the first keeps its own."""
    w = Window.partitionBy("group").orderBy(key)
    return rows.select(key, group.alias("group"), F.col(value)).withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))
