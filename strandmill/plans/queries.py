"""Every registered query, and beside it SQL that gives the same rows.

Spark builds each result from the operators; the SQL states it another way where it can
(windows for run lengths, recursion for alignment), so a match means more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import archive, shared
from ..functions import bases, fields
from ..operators import align, blocked, index, legacy, metadata, quality
from ..sources import derived as D
from ..sources import fasta
from ..sources.derived import with_tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- reads ---------------------------------------------------------------


@query(with_tables("ref creads", "select cast(length(seq) as integer) as seq_len, contains(seq, 'N') as has_n, count(*) as n_reads, cast(sum(length(seq) - length(translate(seq, 'GC', ''))) as bigint) as gc, min(read_id) as first_read, max(read_id) as last_read from creads group by all"))
def reads_profile(spark, sf_dir) -> DataFrame:
    r = D.customer_reads(spark, sf_dir)
    return r.groupBy(F.length("seq").alias("seq_len"), F.contains("seq", F.lit("N")).alias("has_n")).agg(F.count(F.lit(1)).alias("n_reads"), F.sum(bases.gc_count(F.col("seq"))).cast("long").alias("gc"), F.min("read_id").alias("first_read"), F.max("read_id").alias("last_read"))


@query(with_tables("ref oreads", "select read_id, meta, seq, strand, qual from oreads"))
def fastq_line_fold(spark, sf_dir) -> DataFrame:
    from ..sources.fastq import fold_lines, to_lines

    return fold_lines(to_lines(D.order_reads(spark, sf_dir))).select("read_id", "meta", "seq", "strand", "qual")


@query(with_tables("ref oreads", "select 4 * read_id as line_no, false as is_quality from oreads union all select 4 * read_id + 3, true from oreads where substr(qual, 1, 1) = '@'"))
def fastq_boundaries(spark, sf_dir) -> DataFrame:
    from ..sources.fastq import boundaries, to_lines

    return boundaries(to_lines(D.order_reads(spark, sf_dir)))


@query("select o_orderkey // 1000 as batch, cast(bit_or(case when o_orderkey % 4 = 0 then 0 else 1 end | case when o_orderkey % 3 = 0 then 0 else 2 end) as integer) as flags from orders group by 1")
def strand_flags(spark, sf_dir) -> DataFrame:
    r = D.order_reads(spark, sf_dir, seq=False)
    plus = F.when(F.col("strand") == "+", 1).otherwise(0)
    bare = F.when(F.col("read_id") % 3 == 0, 0).otherwise(2)
    return r.groupBy(F.floor(F.col("read_id") / 1000).cast("long").alias("batch")).agg(F.bit_or(plus.bitwiseOR(bare)).alias("flags"))


# -- header fields -------------------------------------------------------

_TOKENS = "select read_id, unnest(range(len(t))) as field, unnest(t) as value from (select read_id, regexp_split_to_array(substr(meta, 2), '[ #.:-]') as t from {})"
_PRIORITY = "select o_orderkey as read_id, '@' || o_orderpriority || ':' || o_orderstatus || '#' || o_custkey as meta from orders"
_PAGES = "select page_id as read_id, '@' || url as meta from pages union all select c_custkey as read_id, '@' || c_name || case when c_custkey % 3 = 0 then '.' else '' end as meta from customer"


def _priority(spark, sf_dir):
    return D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_id"), F.concat(F.lit("@"), "o_orderpriority", F.lit(":"), "o_orderstatus", F.lit("#"), F.col("o_custkey").cast("string")).alias("meta"))


def _pages(spark, sf_dir):
    p = D.table(spark, sf_dir, "pages").select(F.col("page_id").alias("read_id"), F.concat(F.lit("@"), "url").alias("meta"))
    c = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("read_id"), F.concat(F.lit("@"), "c_name", F.when(F.col("c_custkey") % 3 == 0, ".").otherwise("")).alias("meta"))
    return p.unionByName(c)


@query("with m as (" + _PAGES + ") select read_id, cast(field as integer) as field, value from (" + _TOKENS.format("m") + ")")
def meta_tokens(spark, sf_dir) -> DataFrame:
    return metadata.token_table(_pages(spark, sf_dir))


@query("with m as (" + _PRIORITY + ") select regexp_replace(substr(meta, 2), '[^ #.:-]', '', 'g') as separators, cast(length(regexp_replace(substr(meta, 2), '[^ #.:-]', '', 'g')) + 1 as integer) as n_fields, count(*) as n from m group by all")
def meta_separators(spark, sf_dir) -> DataFrame:
    return metadata.separator_counts(_priority(spark, sf_dir))


@query("with m as (" + _PRIORITY + "), s as (select regexp_replace(substr(meta, 2), '[^ #.:-]', '', 'g') as s from m order by read_id limit 1), p as (select unnest(range(length(s))) as position, s from s) select cast(position as integer) as position, substr(s, position + 1, 1) as separator, cast(instr(' .:-#', substr(s, position + 1, 1)) - 1 as integer) as code from p")
def meta_sep_codes(spark, sf_dir) -> DataFrame:
    return metadata.separator_codes(_priority(spark, sf_dir))


_PROFILE = with_tables(
    "ref oreads",
    "+n as (select count(*) as entries from oreads), t as (" + _TOKENS.format("oreads") + "), p as (select (16 * (read_id + 1) - 1) // entries as chunk, field, value, regexp_matches(value, '^[+-]?[0-9]+$') as num from t, n), "
    "q as (select cast(chunk as integer) as chunk, cast(field as integer) as field, count(*) as n, count(distinct value) as ndv, bool_and(num) as numeric, min(case when num then try_cast(value as bigint) end) as low, max(case when num then try_cast(value as bigint) end) as high, cast(max(length(value)) as integer) as longest, min(value) as first, max(value) as last from p group by 1, 2) ",
)


@query(_PROFILE + "select * from q")
def field_profile_chunked(spark, sf_dir) -> DataFrame:
    return metadata.profile(D.order_reads(spark, sf_dir, seq=False), compat=True)


@query(_PROFILE + ", k as (select *, case when ndv = 1 then case when numeric then 1 else 2 end when numeric and high - low + 1 = n then 0 when numeric then 1 else 2 end as k from q) select field, case when max(ndv) = 1 and min(first) = max(last) then 'CONST' when max(k) = 0 then 'AUTOINC' when max(k) = 1 then 'NUMERIC' else 'ALPHA' end as type from k group by field")
def field_types_compat(spark, sf_dir) -> DataFrame:
    return metadata.types_compat(D.order_reads(spark, sf_dir, seq=False))


_SCHEMA = (
    "t as (" + _TOKENS.format("{src}") + "), r as (select *, regexp_matches(value, '^(0|[1-9][0-9]{{0,17}})$') as num, row_number() over (partition by field order by read_id) - 1 as rn from t), "
    "f as (select cast(field as integer) as field, count(distinct value) as ndv, count(*) as n, bool_and(num) as numeric, min(case when num then try_cast(value as bigint) end) as low, max(case when num then try_cast(value as bigint) end) as high, cast(max(length(value)) as integer) as longest, min(value) as c, "
    "min(case when num then try_cast(value as bigint) - rn end) = max(case when num then try_cast(value as bigint) - rn end) as counts from r group by field), "
    "g as (select *, case when ndv = 1 then 'CONST' when numeric and counts then 'AUTOINC' when numeric then 'NUMERIC' else 'ALPHA' end as type from f), "
    "kinds as (select field, type, case when type <> 'NUMERIC' then ndv end as ndv, n, low, high, longest, cast(case when type in ('CONST', 'AUTOINC') then 0 when type = 'NUMERIC' then length(bin(high + 1)) when g.ndv * 100 < n then length(bin(g.ndv)) else longest * 8 end as bigint) as width, type = 'ALPHA' and g.ndv * 100 < n as mapped, case when type = 'CONST' then c end as constant from g)"
)
_KINDS = with_tables("ref oreads", "+" + _SCHEMA.format(src="oreads") + " ")


@query(_KINDS + "select * from kinds")
def field_types(spark, sf_dir) -> DataFrame:
    return metadata.schema(D.order_reads(spark, sf_dir, seq=False))


_WORDS = ", words as (select field, value, cast(row_number() over (partition by field order by value) - 1 as integer) as code from (select distinct cast(t.field as integer) as field, value from t join kinds on t.field = kinds.field and type = 'ALPHA'))"


@query(_KINDS + _WORDS + " select * from words")
def field_dictionary(spark, sf_dir) -> DataFrame:
    return metadata.dictionary(D.order_reads(spark, sf_dir, seq=False))


@query(" union all ".join(f"select '{c}' as \"column\", count(distinct {c}) as ndv, count({c}) as n, count(distinct {c}) * 100 < count({c}) as mapped from part" for c in ("p_name", "p_brand", "p_type", "p_size")))
def dictionary_rule(spark, sf_dir) -> DataFrame:
    return metadata.dictionary_rule(D.table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type", "p_size"])


_CODES = _KINDS + _WORDS + (
    ", c as (select t.read_id, k.field, k.type, k.width, case when type in ('CONST', 'AUTOINC') then '' when type = 'NUMERIC' then lpad(bin(try_cast(t.value as bigint)), cast(width as integer), '0') when mapped then lpad(bin(w.code), cast(width as integer), '0') "
    "else rpad(array_to_string([lpad(bin(ascii(x)), 8, '0') for x in regexp_split_to_array(t.value, '')], ''), cast(width as integer), '0') end as bits from t join kinds k on t.field = k.field left join words w on w.field = k.field and w.value = t.value)"
)


@query(_CODES + " select read_id, string_agg(bits, '' order by field) as bits from c group by read_id")
def meta_codes(spark, sf_dir) -> DataFrame:
    return metadata.row_codes(D.order_reads(spark, sf_dir, seq=False))


@query(
    _KINDS + _WORDS + ", s as (select k.width, k.n, case type when 'CONST' then 16 + 8 * length(constant) when 'AUTOINC' then 32 when 'NUMERIC' then 16 else case when mapped then 16 + 8 * (select sum(length(value) + 1) from words w where w.field = k.field) else 16 end end as d from kinds k), "
    "a as (select count(*) as n_fields, cast(sum(d) as bigint) as descriptor_bits, cast(sum(width * n) as bigint) as body_bits from s) select n_fields, cast(72 + 3 * (n_fields - 1) as bigint) as header_bits, descriptor_bits, body_bits, (72 + 3 * (n_fields - 1) + descriptor_bits + body_bits + 7) // 8 as bytes from a"
)
def meta_stream_size(spark, sf_dir) -> DataFrame:
    return metadata.stream_size(D.order_reads(spark, sf_dir, seq=False))


@query(with_tables("ref oreads", "select read_id, meta from oreads"))
def meta_roundtrip(spark, sf_dir) -> DataFrame:
    return metadata.decoded(D.order_reads(spark, sf_dir, seq=False))


@query(
    with_tables("ref oreads", "+firsthalf as (select * from oreads where read_id < 500), " + _SCHEMA.format(src="firsthalf") + _WORDS)
    + ", u as (select o.read_id, unnest(range(len(x))) as field, unnest(x) as value from (select read_id, regexp_split_to_array(substr(meta, 2), '[ #.:-]') as x from (select read_id, case when read_id < 500 then meta when read_id % 97 = 0 then replace(meta, '#1', '#2') when read_id % 89 = 0 then replace(meta, ' O', ' Q') else meta end as meta from oreads)) o), "
    "v as (select k.field, case when type = 'CONST' and u.value <> constant then 'constant' when type = 'NUMERIC' and not regexp_matches(u.value, '^(0|[1-9][0-9]{0,17})$') then 'not a number' when type = 'NUMERIC' and length(bin(try_cast(u.value as bigint))) > width then 'overflow' when type = 'ALPHA' and mapped and w.value is null then 'not in dictionary' when type = 'ALPHA' and not mapped and length(u.value) * 8 > width then 'overflow' end as reason "
    "from u join kinds k on u.field = k.field left join words w on w.field = k.field and w.value = u.value) select field, reason, count(*) as n from v where reason is not null group by all"
)
def schema_violations(spark, sf_dir) -> DataFrame:
    reads = D.order_reads(spark, sf_dir, seq=False).select("read_id", "meta")
    known = reads.where("read_id < 500")
    m = F.col("meta")
    changed = reads.withColumn("meta", F.when(F.col("read_id") < 500, m).when(F.col("read_id") % 97 == 0, F.replace(m, F.lit("#1"), F.lit("#2"))).when(F.col("read_id") % 89 == 0, F.replace(m, F.lit(" O"), F.lit(" Q"))).otherwise(m))
    kinds = metadata.frozen(metadata.schema(known))
    return metadata.violations(changed, kinds, metadata.dictionary(known, kinds))


@query('select event_id, event_id // 512 as "group", user_id, user_id - coalesce(lag(user_id) over (partition by event_id // 512 order by event_id), 0) as delta from events')
def numeric_delta(spark, sf_dir) -> DataFrame:
    return metadata.deltas(D.table(spark, sf_dir, "events"), "event_id", "user_id", F.floor(F.col("event_id") / 512).cast("long"))


# -- reference and index -------------------------------------------------


@query(with_tables("fasta", "select regexp_replace(regexp_replace(string_agg(upper(line), '' order by line_no), 'N{11,}', '', 'g'), '[^ACGT]', 'G', 'g') as ref from fasta where line not like '>%'"))
def ref_normalise(spark, sf_dir) -> DataFrame:
    return index.normalise(D.fasta_lines(spark, sf_dir))


_TEXT = "select regexp_replace(regexp_replace(string_agg(upper(line), '' order by line_no), 'N{11,}', '', 'g'), '[^ACGT]', 'G', 'g') as ref from fasta where line not like '>%'"


@query(with_tables("fasta", f"+x as ({_TEXT}), b as (select ref, unnest(range((length(ref) + {blocked.SIZE - 1}) // {blocked.SIZE})) as block from x) select block, substr(ref, cast(block * {blocked.SIZE} + 1 as integer), {blocked.SIZE}) as bases from b"))
def ref_blocks(spark, sf_dir) -> DataFrame:
    """The normalised text by a segmented scan, in blocks."""
    return blocked.normalised(D.fasta_lines(spark, sf_dir))


_SA = with_tables("ref", "+x as (select ref || '$' as s, length(ref) + 1 as n from ref), p as (select unnest(range(n)) as pos, s, n from x), sa as (select cast(row_number() over (order by substr(s, pos + 1)) - 1 as bigint) as \"row\", pos, s, n from p) ")
_BWT = _SA + (
    ", b0 as (select *, substr(s, (pos - 1 + n) % n + 1, 1) as b1, substr(s, (pos - 2 + n) % n + 1, 1) as b2, substr(s, (pos - 3 + n) % n + 1, 1) as b3 from sa), "
    "b as (select \"row\", b1, b2, b3, cast(case when contains(b1 || b2 || b3, '$') then 64 else 16 * (instr('ACGT', b3) - 1) + 4 * (instr('ACGT', b2) - 1) + instr('ACGT', b1) - 1 end as integer) as code from b0)"
)


@query(_SA + 'select "row", pos from sa')
def suffix_array(spark, sf_dir) -> DataFrame:
    return index.suffix_array(D.reference_blocks(spark, sf_dir))


def _bwt(spark, sf_dir):
    ref = D.reference_blocks(spark, sf_dir)
    return shared.materialize(index.bwt(ref, index.suffix_array(ref)), "bwt")


@query(_SA + 'select "row", pos from sa')
def suffix_rows_blocked(spark, sf_dir) -> DataFrame:
    """The suffix array by a difference cover over blocks; ``local`` is small so that the recursion runs at these sizes too."""
    return blocked.suffix_rows(blocked.normalised(D.reference_lines(spark, sf_dir)), local=1024)


@query(_BWT + " select * from b")
def bwt_codes(spark, sf_dir) -> DataFrame:
    return _bwt(spark, sf_dir)


def _grams(k: int) -> str:
    return with_tables("ref", f"+x as (select ref || '$' as s, length(ref) + 1 as n from ref), g as (select substr(s || substr(s, 1, {k - 1}), i, {k}) as gram from (select s, unnest(range(1, n + 1)) as i from x)), c as (select gram, count(*) as n from g group by gram), d as (select gram, n, cast(coalesce(sum(n) over (order by gram rows between unbounded preceding and 1 preceding), 0) as bigint) as before from c) select * from d where not contains(gram, '$')")


@query(_grams(1))
def c_array_1(spark, sf_dir) -> DataFrame:
    return index.gram_counts(D.reference_blocks(spark, sf_dir), 1)


@query(_grams(2))
def c_array_2(spark, sf_dir) -> DataFrame:
    return index.gram_counts(D.reference_blocks(spark, sf_dir), 2)


@query(_grams(3))
def c_array_3(spark, sf_dir) -> DataFrame:
    return index.gram_counts(D.reference_blocks(spark, sf_dir), 3)


def _interval(k: int) -> str:
    return _SA + f"select gram, min(\"row\") as low, max(\"row\") as high from (select \"row\", substr(s, pos + 1, {k}) as gram from sa) where length(gram) = {k} and not contains(gram, '$') group by gram"


@query(_interval(1))
def sa_intervals_1(spark, sf_dir) -> DataFrame:
    ref = D.reference_blocks(spark, sf_dir)
    return index.intervals(ref, index.suffix_array(ref), 1)


@query(_interval(2))
def sa_intervals_2(spark, sf_dir) -> DataFrame:
    ref = D.reference_blocks(spark, sf_dir)
    return index.intervals(ref, index.suffix_array(ref), 2)


@query(_BWT + ', k as (select unnest(range((select max("row") // 288 + 1 from b))) as bucket), c as (select distinct code from b where code < 64) select bucket, c.code, (select count(*) from b where b.code = c.code and b."row" < 288 * bucket) as before from k, c')
def occ_checkpoints(spark, sf_dir) -> DataFrame:
    return index.checkpoints(_bwt(spark, sf_dir))


@query(
    _BWT + ', q as (select "row", cast(("row" * 7) % 64 as integer) as code from b), u as (select "row", code, 1 as seen from b where code < 64 union all select "row", code, 0 from q), '
    'w as (select "row", code, seen, sum(seen) over (partition by code order by "row" range between unbounded preceding and 1 preceding) as n from u) select "row", code, cast(coalesce(n, 0) as bigint) as occ from w where seen = 0'
)
def occ_lookup(spark, sf_dir) -> DataFrame:
    codes = _bwt(spark, sf_dir)
    return index.occurrences(codes, codes.select("row", ((F.col("row") * 7) % 64).cast("int").alias("code")))


@query(with_tables("ref creads", "+p as (select read_id, seq, unnest(range(1, length(seq) - 1)) as position from creads), t as (select read_id, cast(position as integer) as position, substr(seq, position, 3) as triple from p) select read_id, position, triple, cast(case when triple not like '%N%' then 16 * (instr('ACGT', substr(triple, 1, 1)) - 1) + 4 * (instr('ACGT', substr(triple, 2, 1)) - 1) + instr('ACGT', substr(triple, 3, 1)) - 1 end as integer) as code from t"))
def kmer_codes(spark, sf_dir) -> DataFrame:
    """The triples at every position (from 1) of each read."""
    reads = D.customer_reads(spark, sf_dir).where(F.length("seq") >= 3)
    t = reads.select("read_id", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - 2)).alias("position"))
    t = t.select("read_id", "position", F.substr("seq", F.col("position"), F.lit(3)).alias("triple"))
    return t.select("read_id", "position", "triple", bases.triple_code(F.col("triple")).alias("code"))


@query(with_tables("ref creads", "+p as (select read_id, seq, unnest(range(1, length(seq) - 1)) as position from creads), t as (select read_id, cast(position as integer) as position, substr(seq, position, 3) as triple from p) select read_id, position, cast(16 * (instr('ACGT', substr(triple, 1, 1)) - 1) + 4 * (instr('ACGT', substr(triple, 2, 1)) - 1) + instr('ACGT', substr(triple, 3, 1)) - 1 as integer) as code, triple from t where triple not like '%N%'"))
def kmer_decode(spark, sf_dir) -> DataFrame:
    """The letters of every triple's code. Triples with N have no code."""
    return kmer_codes(spark, sf_dir).where("code is not null").select("read_id", "position", "code", bases.triple_of(F.col("code")).alias("triple"))


@query(with_tables("ref creads", "+p as (select read_id, seq, unnest(range(1, length(seq) - 1)) as position from creads), t as (select read_id, cast(position as integer) as position, substr(seq, position, 3) as triple from p) select read_id, position, cast(case when triple like '%N%' then 64 else 16 * (instr('ACGT', substr(triple, 1, 1)) - 1) + 4 * (instr('ACGT', substr(triple, 2, 1)) - 1) + instr('ACGT', substr(triple, 3, 1)) - 1 end as bigint) as entry from t"))
def packed_entries(spark, sf_dir) -> DataFrame:
    """Each read's triple codes (64 for those with N) packed at seven bits, and every entry read back by its number."""
    from ..functions import packed

    digits = F.lpad(F.bin(F.coalesce("code", F.lit(64)).cast("long")), 7, "0")
    rows = kmer_codes(spark, sf_dir).groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("position", digits.alias("bits")))).alias("x"))  # a read's own triples
    held = rows.select("read_id", F.size("x").alias("n"), packed.pack(F.array_join(F.transform("x", lambda e: e["bits"]), "")).alias("data"))
    each = held.select("read_id", "data", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("position"))
    return each.select("read_id", "position", packed.entry(F.col("data"), F.col("position") - 1, 7).alias("entry"))


@query(with_tables("ref creads", "select read_id, reverse(translate(seq, 'ACGT', 'TGCA')) as rc, case when length(seq) % 2 = 1 then substr(reverse(translate(seq, 'ACGT', 'TGCA')), 1, length(seq) // 2) || substr(seq, length(seq) // 2 + 1, 1) || substr(reverse(translate(seq, 'ACGT', 'TGCA')), length(seq) // 2 + 2) else reverse(translate(seq, 'ACGT', 'TGCA')) end as rc_compat from creads"))
def revcomp(spark, sf_dir) -> DataFrame:
    r = D.customer_reads(spark, sf_dir)
    return r.select("read_id", bases.revcomp(F.col("seq")).alias("rc"), bases.revcomp(F.col("seq"), compat=True).alias("rc_compat"))


@query(with_tables("ref creads", "+d as (select read_id, translate(seq, 'ACGTN', '01230') as f, translate(translate(seq, 'ACGTN', '01230'), '0123', '3210') as c from creads), e as (select read_id, lpad(reverse(f), cast(ceil(length(f) / 4.0) * 4 as integer), '0') as f, lpad(c, cast(ceil(length(c) / 4.0) * 4 as integer), '0') as c from d) select read_id, array_to_string([substr('0123456789ABCDEF', 4 * cast(substr(f, 2 * i - 1, 1) as integer) + cast(substr(f, 2 * i, 1) as integer) + 1, 1) for i in range(1, length(f) // 2 + 1)], '') as packed, array_to_string([substr('0123456789ABCDEF', 4 * cast(substr(c, 2 * i - 1, 1) as integer) + cast(substr(c, 2 * i, 1) as integer) + 1, 1) for i in range(1, length(c) // 2 + 1)], '') as packed_rc from e"))
def pack2bit(spark, sf_dir) -> DataFrame:
    r = D.customer_reads(spark, sf_dir)
    return r.select("read_id", bases.pack_2bit(F.col("seq")).alias("packed"), bases.pack_2bit(F.col("seq"), complement=True).alias("packed_rc"))


# -- alignment -----------------------------------------------------------

#: Greedy alignment by recursion over triples: segments (read_id, orn, part, s), last part first; m is the match so far.
_ALIGN = (
    "x as (select ref || '$' as t, length(ref) + 1 as n, ref from ref), p as (select unnest(range(n)) as pos, t, n from x), sa as (select row_number() over (order by substr(t, pos + 1)) as rk, pos, substr(t, pos + 1, 70) as suffix from p), "
    "segs as (select read_id, orn, unnest(range(len(f))) as part, unnest(f) as s from (select read_id, orn, regexp_extract_all(seq, '[ACGT]+|N+') as f from {src})), "
    "g as (select read_id, orn, part, s, length(s) as l, length(s) % 3 as d, length(s) % 3 as m, cast(null as varchar) as hit, cast(null as integer) as sym, 0 as no from segs where s not like 'N%' "
    "union all select read_id, orn, part, s, l, d + 3, case when ok then m + 3 else 0 end, case when not ok then substr(s, l - d + 1, m) when d + 3 >= l then substr(s, 1, m + 3) end, "
    "case when not ok then 16 * (instr('ACGT', substr(s, l - d - 2, 1)) - 1) + 4 * (instr('ACGT', substr(s, l - d - 1, 1)) - 1) + instr('ACGT', substr(s, l - d, 1)) - 1 when d + 3 >= l then 64 end, no + 1 "
    "from (select g.*, contains(x.ref, substr(s, l - d - 2, m + 3)) as ok from g, x where d + 3 <= l)), "
    "hits as (select read_id, orn, part, no, hit, sym from g where sym is not null union all select read_id, orn, part, 0, s, 64 from segs where length(s) < 3 and s not like 'N%' union all select read_id, orn, part, 0, s, 65 from segs where s like 'N%'), "
    "found as (select hit, max_by(pos, rk) as pos from (select distinct hit from hits where sym < 65) h, sa where starts_with(suffix, hit) group by hit), "
    "tuples as (select read_id, orn, cast(row_number() over (partition by read_id, orn order by part desc, no) - 1 as integer) as tuple_no, case when sym = 65 then 0 else pos end as pos, cast(length(h.hit) as integer) as len, cast(sym as integer) as sym from hits h left join found f on f.hit = h.hit and sym < 65)"
)


def _aligned(src: str, tail: str, more: str = "") -> str:
    return with_tables("ref creads", "+" + more + _ALIGN.format(src=src) + " " + tail, recursive=True)


_FORWARD = "fwd as (select read_id, 0 as orn, seq from creads{}), "
_BOTH = "fwd as (select read_id, 0 as orn, seq from creads union all select read_id, 1, reverse(translate(seq, 'ACGT', 'TGCA')) from creads), "
_BEST = (
    ", cnt as (select read_id, count(*) filter (orn = 0) as f, count(*) filter (orn = 1) as r from tuples group by read_id), pick as (select c.read_id, cast(case when f > 1 and r < f and not contains(seq, 'N') then 1 else 0 end as integer) as orn from cnt c join creads using (read_id)), "
    "best as (select t.* from tuples t join pick p on t.read_id = p.read_id and t.orn = p.orn)"
)


@query(_aligned("fwd", "select read_id, tuple_no, len, sym from tuples", _FORWARD.format(" where seq not like '%N%'")))
def align_forward(spark, sf_dir) -> DataFrame:
    reads = D.customer_reads(spark, sf_dir).where(~F.contains("seq", F.lit("N")))
    return align.tuple_rows(align.aligned(reads, D.reference(spark, sf_dir))).select("read_id", "tuple_no", "len", "sym")


@query(_aligned("fwd", "select read_id, tuple_no, pos, len, sym from tuples", _FORWARD.format(" where seq like '%N%'")))
def align_with_n(spark, sf_dir) -> DataFrame:
    reads = D.customer_reads(spark, sf_dir).where(F.contains("seq", F.lit("N")))
    return align.tuple_rows(align.aligned(reads, D.reference(spark, sf_dir)))


def _best(spark, sf_dir):
    return align.best_strand(D.customer_reads(spark, sf_dir), D.reference(spark, sf_dir))


@query(_aligned("fwd", _BEST + " select read_id, orn, count(*) as n_tuples from best group by all", _BOTH))
def align_best_strand(spark, sf_dir) -> DataFrame:
    return _best(spark, sf_dir).select("read_id", "orn", F.size("tuples").cast("long").alias("n_tuples"))


@query(_aligned("fwd", _BEST + " select read_id, tuple_no, pos from best where sym < 65", _BOTH))
def tuple_positions(spark, sf_dir) -> DataFrame:
    return align.tuple_rows(_best(spark, sf_dir)).where("sym < 65").select("read_id", "tuple_no", "pos")


@query(_aligned("fwd", _BEST + ' select read_id, cast(count(*) over (partition by read_id) as integer) as cnt, orn, tuple_no, pos, len, sym, row_number() over (order by read_id, tuple_no) - 1 as "offset" from best', _BOTH))
def tuple_columns(spark, sf_dir) -> DataFrame:
    return align.tuple_columns(_best(spark, sf_dir))


@query(_aligned("fwd", _BEST + " select count(*) as tuples, count(distinct read_id) as reads, cast(sum(case when sym < 64 then 1 else 0 end) as bigint) as mismatches from best", _BOTH))
def tuple_counts(spark, sf_dir) -> DataFrame:
    t = F.explode("tuples").alias("t")
    rows = _best(spark, sf_dir).select("read_id", t)
    per = rows.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("t.sym") < 64, 1).otherwise(0)).alias("m"))
    return per.agg(F.sum("n").cast("long").alias("tuples"), F.count(F.lit(1)).alias("reads"), F.sum("m").cast("long").alias("mismatches"))


@query(with_tables("ref creads", "select read_id, seq from creads"))
def seq_decode(spark, sf_dir) -> DataFrame:
    return align.decoded(_best(spark, sf_dir), D.reference(spark, sf_dir))


def _stored(spark, sf_dir):
    """The tables of an index that was written and loaded again."""
    path = shared.path(spark, "index")
    fasta.build_index(D.reference(spark, sf_dir), path)
    return fasta.load_index(spark, path)


@query(_aligned("fwd", _BEST + " select read_id, tuple_no, pos, len, sym from best", _BOTH))
def stored_index_align(spark, sf_dir) -> DataFrame:
    tables = _stored(spark, sf_dir)
    return align.tuple_rows(align.best_strand(D.customer_reads(spark, sf_dir), tables["ref"], sa=tables["sa"])).select("read_id", "tuple_no", "pos", "len", "sym")


@query(_BWT + ', s as (select "row", pos from sa) select s."row", s.pos, b.code from s join b on s."row" = b."row"')
def stored_index_rows(spark, sf_dir) -> DataFrame:
    tables = _stored(spark, sf_dir)
    return tables["sa"].join(tables["bwt"].select("row", "code"), "row").select("row", "pos", "code")


def _blocked(spark, sf_dir) -> blocked.BlockedIndex:
    """A stored index of blocks and buckets, which no task or driver holds."""
    path = shared.path(spark, "blocked")
    blocked.build(blocked.normalised(D.reference_lines(spark, sf_dir)), path, every=8)
    return blocked.BlockedIndex.load(spark, path, every=8)


@query(_aligned("fwd", _BEST + " select read_id, orn, tuple_no, pos, len, sym from best", _BOTH))
def align_blocked(spark, sf_dir) -> DataFrame:
    """Reads sorted among the windows of a stored text, a match a round."""
    return align.tuple_rows(blocked.best_strand(D.customer_reads(spark, sf_dir), _blocked(spark, sf_dir)))


@query(with_tables("ref creads", "select read_id, seq from creads"))
def decode_blocked(spark, sf_dir) -> DataFrame:
    found = _blocked(spark, sf_dir)
    return blocked.decoded(shared.materialize(blocked.best_strand(D.customer_reads(spark, sf_dir), found), "best"), found)


@query(with_tables("ref oreads", "select read_id, meta, seq, strand, read_id % 3 = 0 as repeated, qual from oreads"))
def archive_roundtrip(spark, sf_dir) -> DataFrame:
    tables, path = _stored(spark, sf_dir), shared.path(spark, "archive")
    reads = shared.materialize(_spread(D.order_reads(spark, sf_dir)).withColumn("repeated", F.col("read_id") % 3 == 0), "reads")  # every stream is made from them
    archive.compress(reads, tables["ref"], path, tables["sa"])
    return archive.decompress(spark, path, tables["ref"])


@query(with_tables("ref oreads", "select count(*) as reads, count(*) as equal, cast(sum(length(meta) + length(seq) + length(qual)) as bigint) as chars from oreads"))
def read_roundtrip(spark, sf_dir) -> DataFrame:
    reads, ref = shared.materialize(_spread(D.order_reads(spark, sf_dir)), "reads"), D.reference(spark, sf_dir)
    seq = align.decoded(align.best_strand(reads, ref), ref).withColumnRenamed("read_id", "i")
    meta = metadata.decoded(reads).withColumnRenamed("read_id", "j").withColumnRenamed("meta", "m")
    qual = quality.unsymbol(quality.symbols(reads)).withColumnRenamed("read_id", "k").withColumnRenamed("qual", "q")
    all3 = reads.join(seq.withColumnRenamed("seq", "s"), F.col("read_id") == F.col("i")).join(meta, F.col("read_id") == F.col("j")).join(qual, F.col("read_id") == F.col("k"))
    same = (F.col("s") == F.col("seq")) & (F.col("m") == F.col("meta")) & (F.col("q") == F.col("qual"))
    return all3.agg(F.count(F.lit(1)).alias("reads"), F.count_if(same).alias("equal"), F.sum(F.length("m") + F.length("s") + F.length("q")).cast("long").alias("chars"))


@query(with_tables("ref oreads", "select read_id, meta || chr(10) || seq || chr(10) || strand || case when read_id % 3 = 0 then substr(meta, 2) else '' end || chr(10) || qual as record from oreads"))
def fastq_emit(spark, sf_dir) -> DataFrame:
    from ..sources.fastq import records

    reads = D.order_reads(spark, sf_dir).withColumn("repeated", F.col("read_id") % 3 == 0)
    return records(reads)


@query(with_tables("ref oreads", "select meta, seq, strand, read_id % 3 = 0 as repeated, qual from oreads"))
def fastq_stream(spark, sf_dir) -> DataFrame:
    """Reads written as FASTQ files and taken up again as a stream."""
    from ..sources.fastq import SCHEMA, write
    from ..streaming.fastq_stream import FastqStream

    files, sink = shared.path(spark, "fastq"), shared.path(spark, "reads")
    write(D.order_reads(spark, sf_dir).withColumn("repeated", F.col("read_id") % 3 == 0), files)
    spark.dataSource.register(FastqStream)
    stream = spark.readStream.format("fastq_stream").option("splitBytes", 4 << 20).load(files)
    run = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", shared.path(spark, "stream")).start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return spark.read.schema(SCHEMA).parquet(sink).select("meta", "seq", "strand", "repeated", "qual")


# -- qualities -----------------------------------------------------------

_RUNS = (
    "c as (select read_id, i, substr(qual, cast(i as integer), 1) as ch from (select read_id, qual, unnest(range(1, length(qual) + 1)) as i from quals)), "
    "d as (select *, case when ch = lag(ch) over (partition by read_id order by i) then 0 else 1 end as new from c), e as (select *, sum(new) over (partition by read_id order by i) as run from d), runs as (select read_id, run, any_value(ch) as ch, count(*) as n from e group by read_id, run)"
)
_SYMBOLS = _RUNS + (
    ", parts as (select read_id, run, 0 as k, ascii(ch) - 33 as symbol from runs union all select read_id, run, unnest(range(1, (n - 1) // 60 + 1)), 187 from runs union all select read_id, run, 1000, 127 + (n - 1) % 60 from runs where (n - 1) % 60 > 0), "
    "syms as (select read_id, cast(row_number() over (partition by read_id order by run, k) - 1 as integer) as ord, cast(symbol as integer) as symbol from parts)"
)
_CUM = ", f as (select symbol, count(*) as freq from syms group by 1), model as (select s.symbol, coalesce(freq, 0) as freq, cast(sum(coalesce(freq, 0)) over (order by s.symbol) as bigint) as cum_hi from (select cast(unnest(range(189)) as integer) as symbol) s left join f on f.symbol = s.symbol)"


@query(with_tables("quals", "+" + _SYMBOLS + " select * from syms"))
def qual_symbols(spark, sf_dir) -> DataFrame:
    return quality.symbols(D.order_quals(spark, sf_dir))


@query(with_tables("quals", "+" + _RUNS + " select n as length, count(*) as runs from runs group by 1"))
def qual_run_hist(spark, sf_dir) -> DataFrame:
    return quality.run_histogram(D.order_quals(spark, sf_dir))


@query(with_tables("quals", '+' + _RUNS + ' select ch as "char", count(*) as n from c group by 1'))
def qual_char_hist(spark, sf_dir) -> DataFrame:
    return quality.char_histogram(D.order_quals(spark, sf_dir))


@query(with_tables("quals", "select length(qual) as length, count(*) as reads from quals group by 1"))
def qual_length_hist(spark, sf_dir) -> DataFrame:
    return D.order_quals(spark, sf_dir).groupBy(F.length("qual").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("reads"))


@query(with_tables("quals", "+" + _SYMBOLS + _CUM + " select symbol, freq, cum_hi - freq as cum_lo, cum_hi from model"))
def qual_cum_freq(spark, sf_dir) -> DataFrame:
    return quality.cumulative(quality.symbols(D.order_quals(spark, sf_dir)))


@query(with_tables("quals", '+' + _SYMBOLS + _CUM + ' select cast(sum(freq) as bigint) as n_symbols, count(*) as "distinct", round(log2(cast(sum(freq) as double)) - sum(freq * log2(cast(freq as double))) / sum(freq), 6) as bits_per_symbol from model where freq > 0'))
def qual_entropy(spark, sf_dir) -> DataFrame:
    return quality.entropy(quality.symbols(D.order_quals(spark, sf_dir)))


@query(with_tables("quals", "+" + _SYMBOLS + _CUM + ", q as (select o_orderkey * 13 % (select sum(freq) from model) as scaled from orders) select cast(scaled as bigint) as scaled, symbol from q join model on cum_hi - freq <= scaled and scaled < cum_hi"))
def qual_interval_lookup(spark, sf_dir) -> DataFrame:
    codes = quality.symbols(D.order_quals(spark, sf_dir))
    total = codes.agg(F.count(F.lit(1)).alias("t"))
    asked = D.table(spark, sf_dir, "orders").select("o_orderkey").join(F.broadcast(total)).select((F.col("o_orderkey") * 13 % F.col("t")).alias("scaled"))
    return quality.interval_lookup(asked, quality.cumulative(codes))


_COST = with_tables(
    "quals",
    "+" + _SYMBOLS + ", f as (select s.symbol, 1 + count(y.symbol) as f from (select cast(unnest(range(189)) as integer) as symbol) s left join (select * from syms where read_id < 256) y on y.symbol = s.symbol group by 1), "
    "b as (select read_id // 256 as batch, sum(log2(cast((select sum(f) from f) as double)) - log2(cast(f.f as double))) as bits from syms join f using (symbol) group by 1), n as (select read_id // 256 as batch, sum(length(qual)) as n from quals group by 1), "
    "costs as (select batch, cast(floor(round(bits, 3) * 10 / n) as bigint) as cost from b join n using (batch)) ",
)


@query(_COST + "select batch, cost, cost <= 40 as reuse from costs")
def qual_refreeze(spark, sf_dir) -> DataFrame:
    return quality.refreeze(D.order_quals(spark, sf_dir), 256)


@query(_COST + "select batch, cost, cost > 40 as reuse from costs")
def qual_refreeze_compat(spark, sf_dir) -> DataFrame:
    return quality.refreeze(D.order_quals(spark, sf_dir), 256, compat=True)


@query(with_tables("quals", "+p as (select read_id // 256 as batch, count(*) as reads, cast(sum(length(qual)) as bigint) as scores from quals group by 1) select *, cast(sum(reads) over (order by batch) as bigint) as total_reads from p"))
def batch_totals(spark, sf_dir) -> DataFrame:
    return quality.batch_totals(D.order_quals(spark, sf_dir), 256)


# -- older codecs --------------------------------------------------------


@query(with_tables("quals", "+" + _RUNS + " select read_id, cast(2 * sum((n + 126) // 127) as bigint) as bytes from runs group by 1"))
def rle_naive_size(spark, sf_dir) -> DataFrame:
    return legacy.naive_run_size(D.order_quals(spark, sf_dir))


@query(with_tables("quals", "+" + _RUNS + " select read_id, cast(10 * sum((n + 14) // 15) + 6 as bigint) as bits from runs group by 1"))
def rle_bit_size(spark, sf_dir) -> DataFrame:
    return legacy.bit_run_size(D.order_quals(spark, sf_dir))


@query(with_tables("quals", "+" + _RUNS + " select read_id, cast(sum(n // 129 * 14 + case n % 129 when 0 then 0 when 1 then 7 else 14 end) as bigint) as bits from runs group by 1"))
def rle_flag_size(spark, sf_dir) -> DataFrame:
    return legacy.flagged_run_size(D.order_quals(spark, sf_dir))


@query(
    with_tables(
        "quals",
        "+h(ch, b) as (values " + ", ".join("('" + c.replace("'", "''") + f"', {len(b)})" for c, b in legacy.HUFFMAN.items()) + "), " + _RUNS + " select read_id, cast(sum(coalesce(b, 22)) as bigint) as bits, cast(ceil(sum(coalesce(b, 22)) / 8.0) as bigint) as bytes from c left join h using (ch) group by 1",
    )
)
def huffman_size(spark, sf_dir) -> DataFrame:
    return legacy.huffman_size(D.order_quals(spark, sf_dir))


_DELTA = _RUNS + (
    ", r as (select *, ascii(ch) - coalesce(lag(ascii(ch)) over (partition by read_id order by run), 72) as step from runs), s as (select read_id, run, step, n - case when step = 0 then 0 else 1 end as rep from r), "
    "parts as (select read_id, run, 0 as k, 45 + step as symbol from s where step <> 0 union all select read_id, run, unnest(range(1, rep // 20 + 1)), 110 from s union all select read_id, run, 1000, 90 + rep % 20 from s where rep % 20 > 0), "
    "deltas as (select read_id, cast(row_number() over (partition by read_id order by run, k) - 1 as integer) as ord, cast(symbol as integer) as symbol from parts)"
)


@query(with_tables("quals", "+" + _DELTA + " select * from deltas"))
def delta_run_symbols(spark, sf_dir) -> DataFrame:
    return legacy.delta_runs(D.order_quals(spark, sf_dir))


@query(with_tables("quals", "+" + _DELTA + f" select read_id, cast(sum({list(legacy.DELTA_BITS)}[symbol + 1]) + {legacy.DELTA_BITS[45]} as bigint) as bits from deltas group by read_id"))
def delta_run_size(spark, sf_dir) -> DataFrame:
    return legacy.delta_run_size(D.order_quals(spark, sf_dir))


def _spread(rows: DataFrame) -> DataFrame:
    """A table of one small file as rows in all tasks, four a core, for coders whose work is far more than the reading."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "read_id")


@query(with_tables("quals", "select read_id, qual from quals where length(qual) > 0"))
def adaptive_roundtrip(spark, sf_dir) -> DataFrame:
    """Counts that coder and decoder learn as they go, in parts of 64 read numbers."""
    return quality.adaptive_read(quality.adaptive_code(D.order_quals(spark, sf_dir)))


@query(with_tables("quals", "select read_id, qual from quals where length(qual) > 0"))
def arith_roundtrip(spark, sf_dir) -> DataFrame:
    quals = _spread(D.order_quals(spark, sf_dir))
    cum = quality.smoothed(quality.model(quals))
    return quality.arithmetic_read(quality.arithmetic_code(quals, cum), cum)


@query(with_tables("quals", "select read_id, qual from quals"))
def lzw_roundtrip(spark, sf_dir) -> DataFrame:
    return legacy.lzw_read(legacy.lzw(_spread(D.order_quals(spark, sf_dir))))


@query(with_tables("quals", "select read_id, codec, qual from quals, (values " + ", ".join(f"('{c}')" for c in legacy.CODECS) + ") c(codec)"))
def codecs_roundtrip(spark, sf_dir) -> DataFrame:
    """Every string is read once and goes through all codecs in its task; its bytes are a table between coder and decoder."""
    return legacy.read_each(legacy.coded_each(_spread(D.order_quals(spark, sf_dir))))


# -- streams -------------------------------------------------------------


@query("select event_type, count(*) as n, min(event_id) as first_event, max(event_id) as last_event, cast(sum(length(props)) as bigint) as chars from events group by 1")
def stream_batches(spark, sf_dir) -> DataFrame:
    from ..streaming.batches import totals_by_type

    return totals_by_type(spark, sf_dir)


# -- packed streams ------------------------------------------------------


@query(with_tables("ref oreads", "select read_id, meta from oreads"))
def meta_stream_roundtrip(spark, sf_dir) -> DataFrame:
    from ..operators import streams

    return streams.metadata_read(streams.metadata_stream(D.order_reads(spark, sf_dir, seq=False)))


@query(with_tables("quals", "select read_id, qual from quals where length(qual) > 0"))
def qual_stream_roundtrip(spark, sf_dir) -> DataFrame:
    from ..operators import streams

    return streams.quality_read(streams.quality_stream(_spread(D.order_quals(spark, sf_dir))))


@query(_CODES + ", rowbits as (select read_id, string_agg(bits, '' order by field) as bits from c group by read_id), p as (select read_id, rpad(bits, cast((length(bits) + 7) // 8 * 8 as integer), '0') as bits from rowbits) select read_id, array_to_string([substr('0123456789ABCDEF', 8 * cast(substr(bits, 4 * i - 3, 1) as integer) + 4 * cast(substr(bits, 4 * i - 2, 1) as integer) + 2 * cast(substr(bits, 4 * i - 1, 1) as integer) + cast(substr(bits, 4 * i, 1) as integer) + 1, 1) for i in range(1, length(bits) // 4 + 1)], '') as packed, length(bits) // 8 as bytes, bits from p")
def bit_packing(spark, sf_dir) -> DataFrame:
    from ..functions import packed

    rows = metadata.row_codes(D.order_reads(spark, sf_dir, seq=False)).select("read_id", packed.pack(F.col("bits")).alias("b"), packed.size(F.length("bits")).alias("bytes"))
    return rows.select("read_id", F.hex("b").alias("packed"), "bytes", packed.unpack(F.col("b")).alias("bits"))


@query("with m as (" + _PAGES + "), p as (select read_id, regexp_split_to_array(meta, '[@. :#/]') as p from m) select read_id, cast(i - 1 as integer) as field, p[i + 1] as value, regexp_matches(p[i + 1], '^[0-9]+$') as numeric from (select read_id, p, unnest(range(1, len(p))) as i from p)")
def meta_tokens_prototype(spark, sf_dir) -> DataFrame:
    """Every field under the older set of separators, which has the slash and no dash, and whether it is a number."""
    parts = F.split("meta", "[@. :#/]", -1)
    fields = _pages(spark, sf_dir).select("read_id", F.posexplode(F.slice(parts, 2, F.size(parts))).alias("field", "value"))
    return fields.select("read_id", "field", "value", F.col("value").rlike("^[0-9]+$").alias("numeric"))


@query(
    with_tables(
        "quals",
        "+h(ch, b) as (values " + ", ".join("('" + c.replace("'", "''") + f"', {len(b)})" for c, b in legacy.HUFFMAN.items()) + "), " + _RUNS + ", s as (select sum(length(qual)) as plain from quals where length(qual) > 0), x as ("
        "select 'naive runs' as codec, cast(sum(2 * ((n + 126) // 127)) as bigint) as bytes from runs union all select 'bit runs', cast(sum(b) as bigint) from (select (10 * sum((n + 14) // 15) + 6 + 7) // 8 as b from runs group by read_id) "
        "union all select 'flagged runs', cast(sum(b) as bigint) from (select (sum(n // 129 * 14 + case n % 129 when 0 then 0 when 1 then 7 else 14 end) + 7) // 8 as b from runs group by read_id) "
        "union all select 'huffman', cast(sum(b) as bigint) from (select (sum(coalesce(b, 22)) + 7) // 8 as b from c left join h using (ch) group by read_id)) select codec, bytes, round(100.0 * bytes / plain, 4) as percent from x, s",
    )
)
def codec_sizes(spark, sf_dir) -> DataFrame:
    q = D.order_quals(spark, sf_dir)
    plain = q.agg(F.sum(F.length("qual")).alias("plain"))
    up = lambda c: F.ceil(F.col(c) / 8)
    sized = {"naive runs": legacy.naive_run_size(q), "bit runs": legacy.bit_run_size(q).select(up("bits").alias("bytes")), "flagged runs": legacy.flagged_run_size(q).select(up("bits").alias("bytes")), "huffman": legacy.huffman_size(q)}
    whole = None
    for name, rows in sized.items():
        one = rows.agg(F.sum("bytes").cast("long").alias("bytes")).select(F.lit(name).alias("codec"), "bytes")
        whole = one if whole is None else whole.unionByName(one)
    return whole.join(F.broadcast(plain)).select("codec", "bytes", F.round(F.lit(100.0) * F.col("bytes") / F.col("plain"), 4).alias("percent"))
