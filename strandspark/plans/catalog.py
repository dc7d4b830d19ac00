"""Named queries over the derived reads, each with DuckDB SQL that says the same in its own way."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import dedup, measures, ranges, realign, repeats, reports, stats, view
from ..sources import sam
from ..sources.header import Header
from . import derived
from .derived import INTERVALS_SQL, ORDER, REFERENCE_SQL, SQL

QUERIES, ORACLE = {}, {}
_O = ", ".join(ORDER)
_LINE = "l_linenumber, l_partkey, l_suppkey, name"
_SEQS = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {s})" for n, (i, s) in derived.SEQUENCES.items()) + ") v(ref_id, ref_name, length))"


def query(name: str, sql: str | None = None):
    """Register a function of (reads, spark, sf_dir); ``{reads}`` in the SQL is the relation."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(derived.reads(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLE[name] = sql.replace("{reads}", SQL).replace("{intervals}", INTERVALS_SQL).replace("{seqs}", _SEQS).replace("{reference}", REFERENCE_SQL).replace("{order}", _O)
        return f

    return add


def _long(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# counting -------------------------------------------------------------------------------------------------------------


@query("q_count", "SELECT count(*) AS reads FROM {reads}")
def _(r, spark, d):
    return r.agg(F.count("*").alias("reads"))


@query("q_count_multi", "SELECT 3 * count(*) AS reads FROM {reads}")
def _(r, spark, d):
    return view.merge(r, r, r).agg(F.count("*").alias("reads"))


_FLAGSTAT = """SELECT ref_id, count(*) AS total, count(*) FILTER (flag & 1024 <> 0) AS duplicates, count(*) FILTER (flag & 512 <> 0) AS failed_qc, count(*) FILTER (flag & 4 = 0) AS mapped,
 count(*) FILTER (flag & 16 <> 0) AS reverse_strand, count(*) FILTER (flag & 16 = 0) AS forward_strand, count(*) FILTER (flag & 1 <> 0) AS paired,
 count(*) FILTER (flag & 65 = 65) AS first_mate, count(*) FILTER (flag & 129 = 129) AS second_mate, count(*) FILTER (flag & 13 = 1) AS both_mapped,
 count(*) FILTER (flag & 13 = 9) AS singletons, count(*) FILTER (flag & 3 = 3) AS proper_pairs FROM {reads} GROUP BY ref_id"""


@query("q_flagstat", _FLAGSTAT)
def _(r, spark, d):
    return stats.flagstat(r, ["ref_id"])


@query("q_flagstat_pct", f"""SELECT ref_id, round(mapped * 100.0::DOUBLE / total, 4) AS mapped_pct, round(forward_strand * 100.0::DOUBLE / total, 4) AS forward_strand_pct, round(reverse_strand * 100.0::DOUBLE / total, 4) AS reverse_strand_pct,
 round(failed_qc * 100.0::DOUBLE / total, 4) AS failed_qc_pct, round(duplicates * 100.0::DOUBLE / total, 4) AS duplicates_pct, round(paired * 100.0::DOUBLE / total, 4) AS paired_pct,
 round(proper_pairs * 100.0::DOUBLE / nullif(paired, 0), 4) AS proper_pairs_pct, round(both_mapped * 100.0::DOUBLE / nullif(paired, 0), 4) AS both_mapped_pct, round(first_mate * 100.0::DOUBLE / nullif(paired, 0), 4) AS first_mate_pct,
 round(second_mate * 100.0::DOUBLE / nullif(paired, 0), 4) AS second_mate_pct, round(singletons * 100.0::DOUBLE / nullif(paired, 0), 4) AS singletons_pct FROM ({_FLAGSTAT})""")
def _(r, spark, d):
    return stats.percentages(stats.flagstat(r, ["ref_id"]), ["ref_id"])


@query("q_len_hist", "SELECT read_len, count(*) AS reads FROM {reads} GROUP BY read_len")
def _(r, spark, d):
    return stats.length_histogram(r)


@query("q_insert_mean_median", "SELECT count(*) AS pairs, round(avg(abs(insert_size)), 4) AS mean, CAST(median(abs(insert_size)) AS DOUBLE) AS median FROM {reads} WHERE flag & 65 = 65 AND insert_size <> 0")
def _(r, spark, d):
    return stats.insert_sizes(r)


@query("q_sorted_check", """WITH p AS (SELECT rg AS block, ref_id, pos, lag(ref_id) OVER w AS pr, lag(pos) OVER w AS pp FROM {reads} WHERE ref_id <> -1 AND pos <> -1
 WINDOW w AS (PARTITION BY rg ORDER BY score, name, {order}))
 SELECT block, count(*) FILTER (pr > ref_id OR (pr = ref_id AND pp > pos)) AS breaks, count(*) FILTER (pr > ref_id OR (pr = ref_id AND pp > pos)) = 0 AS is_sorted FROM p GROUP BY block""")
def _(r, spark, d):
    return stats.out_of_order(r, ["score", "name", *[c for c in ORDER if c not in ("score", "name")]], F.col("rg"), F.floor(F.col("score") / 1000))


# view -----------------------------------------------------------------------------------------------------------------

_COLS = "name, flag, ref_id, pos, mapq, read_len"
_cols = _COLS.split(", ")


def _view(name, sql, **options):
    @query(name, f"SELECT {_COLS} FROM {{reads}} WHERE {sql}")
    def _(r, spark, d):
        return view.filter_reads(r, **options).select(*_cols)


_view("q_view_mapq", "mapq >= 30", mapq=30)
_view("q_view_len_exact", "read_len = 64", length="64")
_view("q_view_len_range", "read_len BETWEEN 64 AND 72", length="64-72")
_view("q_view_len_min", "read_len >= 64", length="+64")
_view("q_view_len_max", "read_len <= 64", length="-64")
_view("q_view_region", "ref_id = 1 AND pos + read_len >= 100 AND pos <= 300", region=C.parse_region("chr2:100..300", derived.SEQUENCES))
_view("q_view_region_whole", "ref_id = 2 AND pos + read_len >= 0 AND pos <= 1100", region=C.parse_region("chr3", derived.SEQUENCES))
_view("q_view_region_point", "ref_id = 0 AND pos + read_len >= 250 AND pos <= 250", region=C.parse_region("chr1:250", derived.SEQUENCES))
_view("q_view_combo", "ref_id = 1 AND pos + read_len >= 100 AND pos <= 300 AND mapq >= 20 AND read_len <= 80", region=C.parse_region("chr2:100..300", derived.SEQUENCES), mapq=20, length="-80")


@query("q_view_limit", "SELECT name, flag, ref_id, pos, score FROM {reads} WHERE mapq >= 30 ORDER BY {order} LIMIT 100")
def _(r, spark, d):
    return view.limit_reads(view.filter_reads(r, mapq=30), 100, ORDER).select("name", "flag", "ref_id", "pos", "score")


@query("q_view_trim", "SELECT name, flag, CAST(read_len - 35 AS INT) AS read_len, substr(seq, 11, read_len - 35) AS seq, substr(qual, 11, read_len - 35) AS qual FROM {reads} WHERE read_len > 35")
def _(r, spark, d):
    return view.filter_reads(r, trim=(10, 25)).select("name", "flag", "read_len", "seq", "qual")


@query("q_placed_guard", "SELECT count(*) FILTER (ref_id <> -1 AND pos <> -1) AS placed, count(*) FILTER (ref_id = -1 OR pos = -1) AS skipped FROM {reads}")
def _(r, spark, d):
    placed = (F.col("ref_id") != -1) & (F.col("pos") != -1)
    return r.agg(F.count_if(placed).alias("placed"), F.count_if(~placed).alias("skipped"))


@query("q_flag_predicates", "SELECT flag, " + ", ".join(f"bool_or(flag & {b} <> 0) AS is_{n}" for n, b in C.FLAGS.items()) + " FROM {reads} GROUP BY flag")
def _(r, spark, d):
    return r.select("flag").distinct().select("flag", *[C.has(n).alias(f"is_{n}") for n in C.FLAGS])


@query("q_flag_set_clear", "SELECT DISTINCT flag, " + ", ".join(f"CAST(flag | {b} AS INT) AS set_{n}, CAST(flag - (flag & {b}) AS INT) AS clear_{n}" for n, b in C.FLAGS.items()) + " FROM {reads}")
def _(r, spark, d):
    return r.select("flag").distinct().select("flag", *[C.set_flag(n).alias(f"set_{n}") for n in C.FLAGS], *[C.set_flag(n, False).alias(f"clear_{n}") for n in C.FLAGS])


@query("q_flag_letters", "SELECT DISTINCT flag, concat(" + ", ".join(f"CASE WHEN flag & {1 << i} <> 0 THEN '{c}' ELSE '' END" for i, c in enumerate("pPuUrR12sfd")) + ") AS letters FROM {reads}")
def _(r, spark, d):
    return r.select("flag").distinct().select("flag", C.flag_letters().alias("letters"))


# coverage: the SQL goes base by base ---------------------------------------------------------------------------------

_BINS = "SELECT ref_id, CAST(b // 100 AS INT) AS bin, count(*) AS coverage FROM (SELECT ref_id, unnest(range(pos, pos + read_len + 1)) AS b FROM {reads} WHERE ref_id <> -1 AND pos <> -1) GROUP BY 1, 2"


@query("q_coverage_bins", _BINS)
def _(r, spark, d):
    return stats.coverage_bins(r, 100)


_SPAN = "list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MDN=X]', 1), lambda x: CAST(x AS INT)))"


@query("q_coverage_strict", f"SELECT ref_id, CAST(b // 100 AS INT) AS bin, count(*) AS coverage FROM (SELECT ref_id, unnest(range(pos, pos + CAST({_SPAN} AS INT))) AS b FROM {{reads}} WHERE ref_id <> -1 AND pos <> -1) GROUP BY 1, 2")
def _(r, spark, d):
    return stats.coverage_bins(r, 100, strict=True)


@query("q_coverage_zero_fill", f"SELECT s.ref_name, CAST(100 * g.bin + 1 AS INT) AS position, coalesce(c.coverage, 0) AS coverage FROM {{seqs}} s, (SELECT unnest(range(0, 11)) AS bin) g LEFT JOIN ({_BINS}) c ON c.ref_id = s.ref_id AND c.bin = g.bin")
def _(r, spark, d):
    return stats.zero_filled(stats.coverage_bins(r, 100), derived.sequences(spark), 100)


@query("q_coverage_mean", "SELECT s.ref_name, round(coalesce(n, 0) / s.length, 6) AS mean_coverage FROM {seqs} s LEFT JOIN (SELECT ref_id, CAST(sum(read_len + 1) AS BIGINT) AS n FROM {reads} WHERE ref_id <> -1 GROUP BY 1) c USING (ref_id)")
def _(r, spark, d):
    return stats.mean_coverage(stats.coverage_bins(r, 100), derived.sequences(spark))


_TRUTH_NAME = "concat('chr', CAST(1 + (l_suppkey + l_linenumber % 2) % 5 AS VARCHAR(5)), '_', CAST(pos + l_partkey % 9 AS VARCHAR(9)), '_', CAST(pos + 3 + l_suppkey % 11 AS VARCHAR(9)), '_x')"


def _truth(name, near):
    @query(name, f"""SELECT s.ref_name, count(*) AS reads, count(*) FILTER (split_part(n, '_', 1) = s.ref_name AND ({near})) AS correct
     FROM (SELECT ref_id, pos, {_TRUTH_NAME} AS n FROM {{reads}} WHERE ref_id <> -1) r JOIN {{seqs}} s USING (ref_id) GROUP BY 1""")
    def _(r, spark, d):
        return stats.mapping_truth(r.withColumn("name", F.expr(_TRUTH_NAME)), derived.sequences(spark), strict=name.endswith("strict"))


_truth("q_coverage_verify", "abs(CAST(split_part(n, '_', 2) AS INT) - pos) <= 5 OR abs(CAST(split_part(n, '_', 3) AS INT) - pos) <= 5")
_truth("q_coverage_verify_strict", "abs(CAST(split_part(n, '_', 2) AS INT) - pos) <= 5")

# compare --------------------------------------------------------------------------------------------------------------

# the other file: the same reads, of which some lie elsewhere or are aligned otherwise
_MOVED = "CAST(pos + CASE WHEN l_partkey % 5 = 0 THEN 25 WHEN l_suppkey % 7 = 0 THEN -25 ELSE 0 END AS INT)"
_CHANGED = "CASE WHEN l_linenumber % 4 = 0 AND l_suppkey % 3 = 0 THEN concat(CAST(read_len AS VARCHAR(10)), '=') ELSE cigar END"
_A, _B = "pos, cigar", f"{_MOVED} AS pos, {_CHANGED} AS cigar"
_KEY = "ref_id, pos, cigar"
_SIDE = lambda columns: f"SELECT * FROM (SELECT ref_id, {columns} FROM {{reads}}) WHERE ref_id >= 0 AND pos >= 0"


def _other(r):
    return r.withColumns({"pos": F.expr(_MOVED), "cigar": F.expr(_CHANGED)})


def _sides(r):
    return stats.compared(r), stats.compared(_other(r))


@query("q_compare_counts", f"SELECT (SELECT count(*) FROM ({_SIDE(_B)} EXCEPT ALL {_SIDE(_A)})) AS added, (SELECT count(*) FROM ({_SIDE(_A)} EXCEPT ALL {_SIDE(_B)})) AS removed, (SELECT count(*) FROM ({_SIDE(_A)} INTERSECT ALL {_SIDE(_B)})) AS common")
def _(r, spark, d):
    return stats.compare_counts(*_sides(r))


for _kind, _sql in (("added", f"{_SIDE(_B)} EXCEPT ALL {_SIDE(_A)}"), ("removed", f"{_SIDE(_A)} EXCEPT ALL {_SIDE(_B)}"), ("common", f"{_SIDE(_A)} INTERSECT ALL {_SIDE(_B)}")):

    @query(f"q_compare_{_kind}", _sql)
    def _(r, spark, d, kind=_kind):
        return stats.compare(*_sides(r))[kind]


@query("q_compare_regions", f"""WITH x AS (SELECT {_KEY}, sum(d) AS d FROM (SELECT *, 1 AS d FROM ({_SIDE(_A)}) UNION ALL SELECT *, -1 AS d FROM ({_SIDE(_B)})) GROUP BY {_KEY})
 SELECT i.ref_id, i.start, i.stop, CAST(sum(greatest(-d, 0)) AS BIGINT) AS added, CAST(sum(greatest(d, 0)) AS BIGINT) AS removed
 FROM x JOIN {{intervals}} i ON x.ref_id = i.ref_id AND x.pos BETWEEN i.start AND i.stop WHERE d <> 0 GROUP BY 1, 2, 3""")
def _(r, spark, d):
    return stats.compare_regions(*_sides(r), derived.intervals(spark, d))


def _dictionary(more):
    return f"(SELECT ref_id, concat('chr', CAST(ref_id + 1 AS VARCHAR)) AS ref_name, CAST(max(pos) - max(pos) + {more} AS INT) AS length FROM {{reads}} WHERE ref_id >= 0 GROUP BY ref_id)"


_DIFFERENT = lambda more: f"(SELECT count(*) = 0 FROM ((SELECT * FROM {{seqs}} EXCEPT ALL SELECT * FROM {_dictionary(more)}) UNION ALL (SELECT * FROM {_dictionary(more)} EXCEPT ALL SELECT * FROM {{seqs}})))"


@query("q_dictionary_equal", f"SELECT {_DIFFERENT('1100')} AS same, {_DIFFERENT('1100 + ref_id % 2')} AS same_but_for_lengths")
def _(r, spark, d):
    made = lambda n: r.filter("ref_id >= 0").select("ref_id").distinct().select("ref_id", F.concat(F.lit("chr"), (F.col("ref_id") + 1).cast("string")).alias("ref_name"), n.cast("int").alias("length"))
    own = derived.sequences(spark)
    a, b = (stats.same_dictionary(own, made(n)) for n in (F.lit(1100), F.col("ref_id") % 2 + 1100))
    return a.crossJoin(b.withColumnRenamed("same", "same_but_for_lengths"))  # one row each


# sort, merge, split ---------------------------------------------------------------------------------------------------


def _ranks(ranked):
    return ranked.select(*_LINE.split(", "), "score", F.col("rank").cast("int").alias("rank"))



@query("q_sort_pos_rank", f"SELECT {_LINE}, score, CAST(row_number() OVER (PARTITION BY ref_id ORDER BY pos, flag & 16, name, flag, score, l_linenumber, l_partkey, l_suppkey) AS INT) AS rank FROM {{reads}}")
def _(r, spark, d):
    order = view.position_order(["score", "l_linenumber", "l_partkey", "l_suppkey"])
    return _ranks(view.ranked(r, ["ref_id"], F.floor(F.col("pos") / 100), order))


@query("q_sort_name_rank", f"SELECT {_LINE}, score, CAST(row_number() OVER (PARTITION BY substr(name, 1, 3) ORDER BY name, {_O}) AS INT) AS rank FROM {{reads}}")
def _(r, spark, d):
    return _ranks(view.ranked(r.withColumn("part", F.substring("name", 1, 3)), ["part"], F.substring("name", 1, 5), ["name", *[c for c in ORDER if c != "name"]]))


@query("q_sort_tag_rank", f"SELECT {_LINE}, score, CAST(row_number() OVER (PARTITION BY rg ORDER BY CASE WHEN score % 3 > 0 THEN score % 100 END NULLS LAST, {_O}) AS INT) AS rank FROM {{reads}}")
def _(r, spark, d):
    tag = F.when(F.col("score") % 3 > 0, F.col("score") % 100)
    return _ranks(view.ranked(r, ["rg"], F.coalesce(tag, F.lit(1 << 62)), [tag.asc_nulls_last(), *ORDER]))


@query("q_sorted_head", "SELECT name, flag, ref_id, pos FROM {reads} ORDER BY ref_id = -1, ref_id, pos, flag & 16, name, flag, score, l_linenumber, l_partkey, l_suppkey LIMIT 200")
def _(r, spark, d):
    return view.sort_reads(r, rest=["score", "l_linenumber", "l_partkey", "l_suppkey"]).limit(200).select("name", "flag", "ref_id", "pos")


@query("q_merge_union", f"SELECT ref_id, pos, count(*) AS reads FROM (SELECT ref_id, pos FROM {{reads}} UNION ALL SELECT ref_id, {_MOVED} AS pos FROM {{reads}}) GROUP BY ref_id, pos")
def _(r, spark, d):
    return view.merge(r, _other(r)).groupBy("ref_id", "pos").agg(F.count("*").alias("reads"))


@query("q_split_chain", "SELECT CAST(CASE WHEN ref_id < 0 THEN 0 ELSE ref_id % 4 END AS INT) AS chain, count(*) AS reads, CAST(sum(score) AS BIGINT) AS score FROM {reads} GROUP BY 1")
def _(r, spark, d):
    return r.groupBy(view.chain(4).alias("chain")).agg(F.count("*").alias("reads"), F.sum("score").alias("score"))


_TOGGLE = "SELECT *, CAST((row_number() OVER (PARTITION BY {k} ORDER BY {order}) - 1) // 2 AS INT) AS pair, CAST((row_number() OVER (PARTITION BY {k} ORDER BY {order}) - 1) % 2 AS INT) AS mate FROM {reads}"


@query("q_pair_toggle", "SELECT name, rg, pair, count(*) AS members, CAST(sum(score) AS BIGINT) AS score FROM (" + _TOGGLE.replace("{k}", "rg, name") + ") GROUP BY 1, 2, 3")
def _(r, spark, d):
    return view.toggle_pairs(r, ["rg", "name"], ORDER).groupBy("name", "rg", "pair").agg(F.count("*").alias("members"), F.sum("score").alias("score"))


@query("q_fastq_lines", "SELECT '@' || name || chr(10) || seq || chr(10) || '+' || name || chr(10) || qual AS record FROM {reads}")
def _(r, spark, d):
    return view.fastq_lines(r)


_TNAME = _TOGGLE.replace("{k}", "name")
_BY_NAME = "(PARTITION BY name ORDER BY {order})"


@query("q_fastq_pairs", f"""WITH t AS (SELECT name, flag, seq, qual, row_number() OVER {_BY_NAME} AS n, lead(flag) OVER {_BY_NAME} AS f2, lead(seq) OVER {_BY_NAME} AS s2, lead(qual) OVER {_BY_NAME} AS q2 FROM {{reads}})
 SELECT name, CASE WHEN f2 & 16 <> 0 THEN seq ELSE s2 END AS seq1, CASE WHEN f2 & 16 <> 0 THEN qual ELSE q2 END AS qual1,
 reverse(translate(CASE WHEN f2 & 16 <> 0 THEN s2 ELSE seq END, 'ACGTacgt', 'TGCAtgca')) AS seq2, reverse(CASE WHEN f2 & 16 <> 0 THEN q2 ELSE qual END) AS qual2
 FROM t WHERE n % 2 = 1 AND f2 IS NOT NULL""")
def _(r, spark, d):
    return view.fastq_split(r, ORDER)[0]


@query("q_fastq_orphans", f"WITH t AS ({_TNAME}) SELECT name, any_value(seq) AS seq, any_value(qual) AS qual FROM t GROUP BY name, pair HAVING count(*) = 1")
def _(r, spark, d):
    return view.fastq_split(r, ORDER)[1]


# CIGAR ----------------------------------------------------------------------------------------------------------------

_N = lambda ops: f"CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[{ops}]', 1), lambda x: CAST(x AS INT))), 0) AS INT)"
_LEAD = "CAST(coalesce(nullif(regexp_extract(cigar, '^(\\d+)[SH]', 1), ''), '0') AS INT)"
_TRAIL = "CAST(coalesce(nullif(regexp_extract(cigar, '(\\d+)[SH]$', 1), ''), '0') AS INT)"
_FIVE = f"CASE WHEN flag & 16 <> 0 THEN pos + {_N('MDN=X')} - 1 + {_TRAIL} ELSE pos - {_LEAD} END"


@query("q_unclipped_5p", f"SELECT {_LINE}, flag, CAST({_FIVE} AS INT) AS coord FROM {{reads}}")
def _(r, spark, d):
    return r.select(*_LINE.split(", "), "flag", C.five_prime().alias("coord"))


@query("q_ref_len", f"SELECT cigar, any_value({_N('MDN=X')}) AS ref_len FROM {{reads}} GROUP BY cigar")
def _(r, spark, d):
    return r.select("cigar").distinct().select("cigar", C.reference_length().alias("ref_len"))


@query("q_read_size", f"SELECT cigar, any_value({_N('MIS=X')}) AS size FROM {{reads}} GROUP BY cigar")
def _(r, spark, d):
    return r.select("cigar").distinct().select("cigar", C.read_size().alias("size"))


@query("q_end_pos", f"SELECT DISTINCT cigar, pos, CAST(pos + {_N('MDN=X')} AS INT) AS end_open, CAST(pos + {_N('MDN=X')} - 1 AS INT) AS end_closed, CAST(pos + {_N('MDN=XI')} AS INT) AS end_padded FROM {{reads}}")
def _(r, spark, d):
    return r.select("cigar", "pos").distinct().select("cigar", "pos", C.end_position().alias("end_open"), C.end_position(closed=True).alias("end_closed"), C.end_position(padded=True).alias("end_padded"))


@query("q_cigar_ops", "SELECT cigar, place, CAST(regexp_extract(x, '\\d+') AS INT) AS len, right(x, 1) AS op FROM (SELECT DISTINCT cigar, unnest(range(0, len(regexp_extract_all(cigar, '\\d+[A-Z=]'))))::INT AS place, unnest(regexp_extract_all(cigar, '\\d+[A-Z=]')) AS x FROM {reads})")
def _(r, spark, d):
    return r.select("cigar").distinct().select("cigar", F.posexplode(C.cigar_ops()).alias("place", "x")).select("cigar", "place", "x.len", "x.op")


@query("q_alignment_blocks", """WITH c AS (SELECT DISTINCT cigar, pos FROM {reads}), o AS (SELECT cigar, pos, unnest(range(1, len(regexp_extract_all(cigar, '\\d+[A-Z=]')) + 1)) AS i, unnest(regexp_extract_all(cigar, '\\d+[A-Z=]')) AS x FROM c),
 p AS (SELECT *, CAST(regexp_extract(x, '\\d+') AS INT) AS n, right(x, 1) AS op FROM o),
 s AS (SELECT *, coalesce(sum(CASE WHEN op IN ('M','I','S','=','X') THEN n ELSE 0 END) OVER w, 0) AS q, coalesce(sum(CASE WHEN op IN ('M','D','N','=','X') THEN n ELSE 0 END) OVER w, 0) AS r FROM p
   WINDOW w AS (PARTITION BY cigar, pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT cigar, pos, CAST(q AS INT) AS read_start, CAST(pos + r AS INT) AS ref_start, n AS len FROM s WHERE op IN ('M', '=', 'X')""")
def _(r, spark, d):
    return r.select("cigar", "pos").distinct().select("cigar", "pos", F.explode(C.alignment_blocks()).alias("b")).select("cigar", "pos", "b.*")


@query("q_unclip_cigar", "SELECT DISTINCT cigar, regexp_replace(cigar, '\\d+[SHP]', '', 'g') AS unclipped FROM {reads}")
def _(r, spark, d):
    return r.select("cigar").distinct().select("cigar", C.unclip_cigar().alias("unclipped"))


# qualities, bases, tags -----------------------------------------------------------------------------------------------


@query("q_score_sum", "SELECT qual, CAST(coalesce(list_sum(list_filter(list_transform(string_split(qual, ''), lambda c: ord(c) - 33), lambda q: q >= 15)), 0) AS INT) AS score_sum FROM (SELECT DISTINCT qual FROM {reads})")
def _(r, spark, d):
    return r.select("qual").distinct().select("qual", C.quality_sum().alias("score_sum"))


@query("q_phred_prob", "SELECT qual, round(list_avg(list_transform(string_split(qual, ''), lambda c: 1 - pow(10.0::DOUBLE, -(ord(c) - 33) / 10.0::DOUBLE))), 6) AS mean_quality FROM (SELECT DISTINCT qual FROM {reads})")
def _(r, spark, d):
    return r.select("qual").distinct().select("qual", F.round(C.mean_base_quality(), 6).alias("mean_quality"))


@query("q_revcomp", "SELECT seq, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS revcomp FROM {reads}")
def _(r, spark, d):
    return r.select("seq", C.reverse_complement("seq").alias("revcomp"))


_TWO = "(SELECT DISTINCT substr(seq, 1, 1) AS a, lower(substr(seq, 2, 1)) AS b, flag & 16 <> 0 AS rev FROM {reads})"


@query("q_regular_base", f"SELECT a, b, rev, a IN ('A','C','G','T') AS regular_a, b IN ('a','c','g','t') AS regular_b, a = upper(b) AS equal FROM {_TWO}")
def _(r, spark, d):
    x = r.select(F.substring("seq", 1, 1).alias("a"), F.lower(F.substring("seq", 2, 1)).alias("b"), C.has("reverse").alias("rev")).distinct()
    return x.select("a", "b", "rev", C.is_regular_base("a").alias("regular_a"), C.is_regular_base("b").alias("regular_b"), C.bases_equal("a", "b").alias("equal"))


@query("q_bisulfite_eq", f"SELECT a, b, rev, a = upper(b) OR (NOT rev AND b = 'c' AND a = 'T') OR (rev AND b = 'g' AND a = 'A') AS equal FROM {_TWO}")
def _(r, spark, d):
    x = r.select(F.substring("seq", 1, 1).alias("a"), F.lower(F.substring("seq", 2, 1)).alias("b"), C.has("reverse").alias("rev")).distinct()
    return x.select("a", "b", "rev", C.bisulfite_equal("a", "b", "rev").alias("equal"))


_TAG = "CASE WHEN l_partkey % 3 > 0 THEN CAST(mapq % 5 AS VARCHAR(3)) END"


@query("q_tag_ops", f"""SELECT {_LINE}, score, rg_value, CASE WHEN rg_value IS NOT NULL THEN 'Z' END AS rg_type, nm IS NOT NULL AS has_nm, nm, coalesce(nm, '7') AS nm_after_add, '99' AS nm_after_edit, CASE WHEN nm IS NULL THEN 'i' ELSE 'C' END AS nm_type_after_add,
 false AS has_rg_after_remove, CAST(CASE WHEN nm IS NULL THEN 0 ELSE 1 END AS INT) AS left_over FROM (SELECT {_LINE}, score, CASE WHEN l_suppkey % 4 > 0 THEN rg END AS rg_value, {_TAG} AS nm FROM {{reads}})""")
def _(r, spark, d):
    entry = lambda k, t, v: F.struct(F.lit(k).alias("key"), F.struct(F.lit(t).alias("type"), v.alias("value")).alias("value"))
    listed = F.array(entry("RG", "Z", F.when(F.col("l_suppkey") % 4 > 0, F.col("rg"))), entry("NM", "C", F.expr(_TAG)))
    x = r.withColumn("tags", F.map_from_entries(F.filter(listed, lambda e: e["value"]["value"].isNotNull())))
    return x.select(
        *_LINE.split(", "), "score", C.tag("RG").alias("rg_value"), C.tag_type("RG").alias("rg_type"), C.has_tag("NM").alias("has_nm"), C.tag("NM").alias("nm"), C.tag("NM", C.add_tag("NM", "i", F.lit(7))).alias("nm_after_add"),
        C.tag("NM", C.edit_tag("NM", "i", F.lit(99))).alias("nm_after_edit"), C.tag_type("NM", C.add_tag("NM", "i", F.lit(7))).alias("nm_type_after_add"), C.has_tag("RG", C.remove_tag("RG")).alias("has_rg_after_remove"), F.size(C.remove_tag("RG")).alias("left_over"),
    )


@query("q_ucsc_bin", f"""SELECT pos, e AS end_pos, CAST(CASE WHEN pos >> 14 = (e - 1) >> 14 THEN 4681 + (pos >> 14) WHEN pos >> 17 = (e - 1) >> 17 THEN 585 + (pos >> 17) WHEN pos >> 20 = (e - 1) >> 20 THEN 73 + (pos >> 20)
 WHEN pos >> 23 = (e - 1) >> 23 THEN 9 + (pos >> 23) WHEN pos >> 26 = (e - 1) >> 26 THEN 1 + (pos >> 26) ELSE 0 END AS INT) AS bin FROM (SELECT DISTINCT CAST(pos * 977 AS INT) AS pos, CAST(pos * 977 + {_N('MDN=X')} * 31 AS INT) AS e FROM {{reads}})""")
def _(r, spark, d):
    x = r.select((F.col("pos") * 977).alias("pos"), (F.col("pos") * 977 + C.reference_length() * 31).alias("end_pos")).distinct()
    return x.select("pos", "end_pos", C.ucsc_bin("pos", "end_pos").alias("bin"))


@query("q_linear_index", f"SELECT ref_id, CAST(w AS INT) AS window, min(score) AS offset FROM (SELECT ref_id, score, unnest(range(pos >> 7, ((pos + {_N('MDN=X')} - 1) >> 7) + 1)) AS w FROM {{reads}} WHERE ref_id >= 0) GROUP BY 1, 2")
def _(r, spark, d):
    return stats.linear_index(r, F.col("score"), 7)


@query("q_index_meta", "SELECT ref_id, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 <> 0) AS unmapped FROM {reads} GROUP BY ref_id")
def _(r, spark, d):
    return stats.index_metadata(r)


# duplicates -----------------------------------------------------------------------------------------------------------

_IDX = "row_number() OVER (ORDER BY {order})"
_ENDS = f"""r AS MATERIALIZED (SELECT *, {_IDX} AS idx FROM {{reads}}),
 e AS MATERIALIZED (SELECT idx, name, rg, flag, score, ref_id, {_FIVE} AS coord, flag & 16 <> 0 AS rev, flag & 9 = 1 AS paired, CASE rg WHEN 'rg0' THEN 'libA' WHEN 'rg1' THEN 'libB' ELSE 'Unknown Library' END AS library
   FROM r WHERE flag & 4 = 0 AND ref_id <> -1 AND flag & 256 = 0),
 f AS (SELECT idx FROM (SELECT idx, paired, bool_or(paired) OVER w AS with_pair, row_number() OVER (PARTITION BY library, ref_id, coord, rev ORDER BY paired, score DESC, idx) AS n FROM e WINDOW w AS (PARTITION BY library, ref_id, coord, rev)) WHERE NOT paired AND (with_pair OR n > 1)),
 t AS (SELECT *, (row_number() OVER (PARTITION BY rg, name ORDER BY idx) - 1) // 2 AS pair FROM e WHERE paired),
 m AS (SELECT a.*, row_number() OVER (PARTITION BY rg, name, pair ORDER BY ref_id, coord, rev, idx) AS side FROM t a),
 p AS (SELECT a.idx AS i, b.idx AS j, row_number() OVER (PARTITION BY a.library, a.ref_id, a.coord, a.rev, b.ref_id, b.coord, b.rev ORDER BY a.score + b.score DESC, least(a.idx, b.idx), greatest(a.idx, b.idx)) AS n
   FROM m a JOIN m b ON a.rg = b.rg AND a.name = b.name AND a.pair = b.pair AND a.side = 1 AND b.side = 2),
 q AS (SELECT i AS idx FROM p WHERE n > 1 UNION SELECT j FROM p WHERE n > 1), dup AS (SELECT idx FROM f UNION SELECT idx FROM q)"""


def _indexed(r):
    """The derived table has no row number: one that follows ORDER."""
    return view.ranked(r, [], F.struct("ref_id", F.floor(F.col("pos") / 100)), ORDER, "idx")


def _groups(spark):
    return derived.read_groups(spark)


@query("q_dedup_library", "SELECT CASE rg WHEN 'rg0' THEN 'libA' WHEN 'rg1' THEN 'libB' ELSE 'Unknown Library' END AS library, count(*) AS reads FROM {reads} GROUP BY 1")
def _(r, spark, d):
    return dedup.with_library(r, _groups(spark)).groupBy("library").agg(F.count("*").alias("reads"))


@query("q_dedup_fragments", f"WITH {_ENDS} SELECT idx FROM f")
def _(r, spark, d):
    return dedup.fragment_duplicates(dedup.ends(dedup.with_library(_indexed(r), _groups(spark)), ["ref_id", "name", "flag"], "score"))


@query("q_dedup_pairs", f"WITH {_ENDS} SELECT idx FROM q")
def _(r, spark, d):
    return dedup.pair_duplicates(dedup.ends(dedup.with_library(_indexed(r), _groups(spark)), ["ref_id", "name", "flag"], "score")).distinct()


_MARKED = "CAST(CASE WHEN flag & 256 <> 0 THEN flag WHEN d.idx IS NOT NULL THEN flag | 1024 ELSE flag - (flag & 1024) END AS INT)"


@query("q_dedup_mark", f"WITH {_ENDS} SELECT r.idx, r.name, {_MARKED} AS flag FROM r LEFT JOIN dup d ON r.idx = d.idx")
def _(r, spark, d):
    return dedup.mark_duplicates(_indexed(r), _groups(spark)).select("idx", "name", "flag")


@query("q_dedup_remove", f"WITH {_ENDS} SELECT r.idx, r.name, {_MARKED} AS flag FROM r LEFT JOIN dup d ON r.idx = d.idx WHERE d.idx IS NULL")
def _(r, spark, d):
    return dedup.mark_duplicates(_indexed(r), _groups(spark), remove=True).select("idx", "name", "flag")


@query("q_mergesort_dedup", f"WITH {_ENDS} SELECT r.idx, r.name, r.pos, {_MARKED} AS flag FROM r LEFT JOIN dup d ON r.idx = d.idx WHERE mapq >= 10")
def _(r, spark, d):
    marked = dedup.mark_duplicates(_indexed(view.merge(r.filter(C.has("reverse")), r.filter(~C.has("reverse")))), _groups(spark))
    return view.sort_reads(view.filter_reads(marked, mapq=10), rest=["idx"]).select("idx", "name", "pos", "flag")


# mates ----------------------------------------------------------------------------------------------------------------


@query("q_mate_fix", f"""WITH t AS (SELECT *, (row_number() OVER (PARTITION BY rg, name ORDER BY {{order}}) - 1) // 2 AS pair, (row_number() OVER (PARTITION BY rg, name ORDER BY {{order}}) - 1) % 2 AS mate, {_N('MDN=X')} AS span FROM {{reads}} WHERE flag & 256 = 0),
 j AS (SELECT s.*, o.flag AS f, o.ref_id AS r, o.pos AS p, o.mapq AS q, s.flag & 4 <> 0 AS su, o.flag & 4 <> 0 AS ou,
   CASE WHEN s.flag & 16 <> 0 THEN s.pos + s.span - 1 ELSE s.pos END AS sfive, CASE WHEN o.flag & 16 <> 0 THEN o.pos + o.span - 1 ELSE o.pos END AS ofive
   FROM t s LEFT JOIN t o ON s.rg = o.rg AND s.name = o.name AND s.pair = o.pair AND s.mate <> o.mate)
 SELECT rg, name, score, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN p IS NULL THEN ref_id WHEN su AND ou THEN -1 WHEN su THEN r ELSE ref_id END AS INT) AS ref_id, CAST(CASE WHEN p IS NULL THEN pos WHEN su AND ou THEN -1 WHEN su THEN p ELSE pos END AS INT) AS pos,
  CAST(CASE WHEN p IS NULL THEN flag ELSE flag - (flag & 40) + CASE WHEN ou THEN 8 ELSE 0 END + CASE WHEN f & 16 <> 0 THEN 32 ELSE 0 END END AS INT) AS flag,
  CAST(CASE WHEN p IS NULL OR (su AND ou) THEN -1 WHEN ou THEN ref_id ELSE r END AS INT) AS mate_ref_id, CAST(CASE WHEN p IS NULL OR (su AND ou) THEN -1 WHEN ou THEN pos ELSE p END AS INT) AS mate_pos,
  CASE WHEN p IS NOT NULL AND NOT su AND NOT ou THEN CAST(q AS VARCHAR) WHEN p IS NOT NULL AND su AND ou THEN NULL ELSE 'old' END AS mq,
  CAST(CASE WHEN p IS NULL THEN insert_size WHEN su OR ou OR ref_id <> r THEN 0 ELSE ofive - sfive END AS BIGINT) AS insert_size FROM j
 UNION ALL SELECT rg, name, score, l_linenumber, l_partkey, l_suppkey, ref_id, pos, flag, -1, -1, 'old', insert_size FROM {{reads}} WHERE flag & 256 <> 0""")
def _(r, spark, d):
    old = F.create_map(F.lit("MQ"), F.struct(F.lit("Z").alias("type"), F.lit("old").alias("value")))
    fixed = ranges.fix_mates(r.withColumn("tags", old), ["rg", "name"], ORDER)
    return fixed.select("rg", "name", "score", "l_linenumber", "l_partkey", "l_suppkey", "ref_id", "pos", "flag", "mate_ref_id", "mate_pos", C.tag("MQ").alias("mq"), "insert_size")


# ranges ---------------------------------------------------------------------------------------------------------------

_ELIGIBLE = "flag & 4 = 0 AND flag & 256 = 0 AND flag & 512 = 0 AND mapq <> 0 AND pos <> -1 AND NOT (flag & 9 = 1 AND (l_partkey + 1) % 4 <> l_partkey % 4 AND l_partkey % 4 = 0) AND read_len <= 3000"


@query("q_realign_eligible", f"SELECT count(*) FILTER ({_ELIGIBLE}) AS eligible, count(*) AS reads FROM {{reads}}")
def _(r, spark, d):
    x = r.withColumn("mate_ref_id", F.when(F.col("l_partkey") % 4 == 0, F.col("ref_id") + 1).otherwise(F.col("ref_id")))
    return x.agg(F.count_if(ranges.realign_eligible()).alias("eligible"), F.count("*").alias("reads"))


_READ_END = f"CASE WHEN flag & 4 <> 0 THEN pos ELSE greatest(pos + read_len + {_N('D')} - {_N('ISH')} - 1, pos) END"
_OVER = f"{{reads}} r JOIN {{intervals}} i ON r.ref_id = i.ref_id AND r.pos <= i.stop AND {_READ_END} >= i.start"


@query("q_interval_assign", f"SELECT {_LINE}, score, flag, pos, min(i.ref_id * 1099511627776 + i.start) AS interval_id FROM {_OVER} GROUP BY {_LINE}, score, flag, pos")
def _(r, spark, d):
    return ranges.assign_interval(r, ranges.with_interval_ids(derived.intervals(spark, d)), [*_LINE.split(", "), "score", "flag", "pos"])


@query("q_interval_overload", f"SELECT interval_id, count(*) AS reads, count(*) >= 200 AS skipped FROM (SELECT {_LINE}, score, flag, pos, min(i.ref_id * 1099511627776 + i.start) AS interval_id FROM {_OVER} GROUP BY {_LINE}, score, flag, pos) GROUP BY 1")
def _(r, spark, d):
    return ranges.overloaded(ranges.assign_interval(r, ranges.with_interval_ids(derived.intervals(spark, d)), [*_LINE.split(", "), "score", "flag", "pos"]), 200)


@query("q_region_reads", f"SELECT i.ref_id, i.start, i.stop, count(*) AS reads, CAST(sum(r.score) AS BIGINT) AS score FROM {_OVER} GROUP BY 1, 2, 3")
def _(r, spark, d):
    return ranges.range_join(r, ranges.with_interval_ids(derived.intervals(spark, d)), 512).groupBy("ref_id", "start", "stop").agg(F.count("*").alias("reads"), F.sum("score").alias("score"))


_ALLELES = "SELECT CAST(l_suppkey % 9 AS DOUBLE) AS flank, concat('chr', CAST(ref_id + 1 AS VARCHAR(3)), ':', CAST(pos AS VARCHAR(9))) AS region, CAST(mapq % 4 + 8 AS INT) AS allele_len, round(CAST(list_avg(list_transform(string_split(qual, ''), lambda c: 1 - pow(10.0::DOUBLE, -(ord(c) - 33) / 10.0::DOUBLE))) AS DOUBLE), 6) AS quality, flag & 16 <> 0 AS reverse FROM {reads} WHERE ref_id >= 0"
_HIST = f"SELECT region, allele_len, count(*) AS reads, round(avg(quality), 4) AS mean_quality, round(avg(flank), 4) AS mean_flank, count(*) FILTER (reverse) AS reverse_reads FROM ({_ALLELES}) GROUP BY 1, 2"


def _alleles(r):
    return r.filter("ref_id >= 0").select(F.concat(F.lit("chr"), (F.col("ref_id") + 1).cast("string"), F.lit(":"), F.col("pos").cast("string")).alias("region"), (F.col("mapq") % 4 + 8).alias("allele_len"), F.round(C.mean_base_quality(), 6).alias("quality"), (F.col("l_suppkey") % 9).cast("double").alias("flank"), C.has("reverse").alias("reverse"))


@query("q_allele_hist", _HIST)
def _(r, spark, d):
    return ranges.allele_histogram(_alleles(r))


_CONC = f"""SELECT region, count(*) AS alleles, CAST(sum(reads) AS BIGINT) AS reads, max(reads) AS most, arg_max(allele_len, reads * 1000 + allele_len) AS majority,
 round(CASE WHEN sum(reads) <= 1 THEN -1 WHEN count(*) = 1 THEN 1 ELSE (max(reads) - 1)::DOUBLE / (sum(reads) - 1)::DOUBLE END, 6) AS concordance FROM ({_HIST}) GROUP BY region"""


@query("q_concordance", _CONC)
def _(r, spark, d):
    return ranges.calls(ranges.allele_histogram(_alleles(r))).drop("call")


@query("q_call_rule", f"SELECT region, CASE WHEN alleles > 9 OR reads <= 1 THEN 'NA' WHEN alleles = 1 OR 100 * (most - 1) >= 99 * (reads - 1) THEN CAST(majority AS VARCHAR) END AS call FROM ({_CONC})")
def _(r, spark, d):
    return ranges.calls(ranges.allele_histogram(_alleles(r))).select("region", "call")


# interval algebra over pairs of the parts' intervals ------------------------------------------------------------------

_IV = "(SELECT DISTINCT CAST(p_partkey % 2 AS INT) AS c1, CAST(p_partkey % 37 AS INT) AS a1, CAST(p_partkey % 37 + p_size % 13 AS INT) AS b1, CAST(p_partkey % 3 % 2 AS INT) AS c2, CAST(p_partkey % 29 AS INT) AS a2, CAST(p_partkey % 29 + p_size % 17 AS INT) AS b2 FROM part)"
_ivs = ["c1", "a1", "b1", "c2", "a2", "b2"]
_OV = "(c1 = c2 AND a1 <= b2 AND a2 <= b1)"


def _known(column, name):
    """-1 for null: an integer column with nulls has another type in some clients."""
    return F.coalesce(column, F.lit(-1)).alias(name)


def _iv(name, sql, make):
    @query(name, f"SELECT {', '.join(_ivs)}, {sql} FROM {_IV}")
    def _(r, spark, d):
        part = spark.read.parquet(f"{d}/part.parquet")
        k, s = F.col("p_partkey"), F.col("p_size")
        x = part.select((k % 2).cast("int").alias("c1"), (k % 37).cast("int").alias("a1"), (k % 37 + s % 13).cast("int").alias("b1"), (k % 3 % 2).cast("int").alias("c2"), (k % 29).cast("int").alias("a2"), (k % 29 + s % 17).cast("int").alias("b2")).distinct()
        return x.select(*_ivs, *make(C.Interval("c1", "a1", "b1"), C.Interval("c2", "a2", "b2")))


_iv("q_interval_overlap", f"{_OV} AS overlaps, NOT {_OV} AS disjoint, (c1 = c2 AND a1 <= b2 + 1 AND a2 <= b1 + 1) AS contiguous, (c1 = c2 AND a1 <= a2 AND b2 <= b1) AS contains, c1 = c2 AS same_contig",
    lambda x, y: [x.overlaps(y).alias("overlaps"), (~x.overlaps(y)).alias("disjoint"), x.contiguous(y).alias("contiguous"), x.contains(y).alias("contains"), x.same_contig(y).alias("same_contig")])
_iv("q_interval_merge", "CASE WHEN c1 = c2 AND a1 <= b2 + 1 AND a2 <= b1 + 1 THEN least(a1, a2) ELSE -1 END AS merge_start, CASE WHEN c1 = c2 AND a1 <= b2 + 1 AND a2 <= b1 + 1 THEN greatest(b1, b2) ELSE -1 END AS merge_stop, CASE WHEN c1 = c2 THEN least(a1, a2) ELSE -1 END AS span_start, CASE WHEN c1 = c2 THEN greatest(b1, b2) ELSE -1 END AS span_stop",
    lambda x, y: [_known(x.merge(y)["start"], "merge_start"), _known(x.merge(y)["stop"], "merge_stop"), _known(x.span(y)["start"], "span_start"), _known(x.span(y)["stop"], "span_stop")])
_iv("q_interval_intersect", f"CASE WHEN {_OV} THEN greatest(a1, a2) ELSE -1 END AS start, CASE WHEN {_OV} THEN least(b1, b2) ELSE -1 END AS stop, CAST(CASE WHEN {_OV} THEN least(b1, b2) - greatest(a1, a2) + 1 ELSE 0 END AS INT) AS size",
    lambda x, y: [_known(x.intersect(y)["start"], "start"), _known(x.intersect(y)["stop"], "stop"), x.overlap_size(y).alias("size")])
_iv("q_interval_subtract", f"CAST(CASE WHEN NOT {_OV} THEN 1 ELSE (a1 < a2)::INT + (b1 > b2)::INT END AS INT) AS pieces, CAST(CASE WHEN NOT {_OV} THEN b1 - a1 + 1 ELSE b1 - a1 + 1 - (least(b1, b2) - greatest(a1, a2) + 1) END AS INT) AS bases",
    lambda x, y: [F.size(x.subtract(y)).alias("pieces"), F.aggregate(x.subtract(y), F.lit(0), lambda s, p: s + p["stop"] - p["start"] + 1).alias("bases")])
_iv("q_interval_split", "CAST(CASE WHEN a2 > a1 AND a2 <= b1 THEN 2 ELSE 1 END AS INT) AS pieces, CAST(CASE WHEN a2 > a1 AND a2 <= b1 THEN a2 - 1 ELSE b1 END AS INT) AS first_stop",
    lambda x, y: [F.size(x.split("a2")).alias("pieces"), x.split("a2")[0]["stop"].alias("first_stop")])
_iv("q_interval_distance", f"CASE WHEN c1 = c2 THEN abs(a1 - a2) ELSE -1 END AS distance, CASE WHEN c1 = c2 THEN greatest(0, a1 - b2, a2 - b1) ELSE -1 END AS min_distance, (c1 < c2 OR (c1 = c2 AND b1 < a2)) AS before, (c1 > c2 OR (c1 = c2 AND a1 > b2)) AS past, CAST(CASE WHEN {_OV} THEN 0 WHEN c1 < c2 OR (c1 = c2 AND b1 < a2) THEN -1 ELSE 1 END AS INT) AS compared, {_OV} AS inside",
    lambda x, y: [_known(x.distance(y), "distance"), _known(x.min_distance(y), "min_distance"), x.before(y).alias("before"), x.past(y).alias("past"), x.compare(y).alias("compared"), x.between(y, y).alias("inside")])
_iv("q_interval_reciprocal", f"CAST(b1 - a1 + 1 AS INT) AS size, round(CASE WHEN {_OV} THEN least((least(b1, b2) - greatest(a1, a2) + 1) / (b1 - a1 + 1), (least(b1, b2) - greatest(a1, a2) + 1) / (b2 - a2 + 1)) ELSE 0 END, 6) AS reciprocal, concat('chr', CAST(c1 AS VARCHAR), ':', CAST(a1 + 1 AS VARCHAR), '-', CAST(b1 + 1 AS VARCHAR)) AS text",
    lambda x, y: [x.size().alias("size"), F.round(x.reciprocal_overlap(y), 6).alias("reciprocal"), x.text(F.concat(F.lit("chr"), F.col("c1").cast("string"))).alias("text")])

_AL = "SELECT DISTINCT substr(seq, 1, 1 + CAST(mapq % 3 AS INT)) AS ref, CASE WHEN mapq % 11 = 0 THEN '.' WHEN mapq % 13 = 0 THEN '<DEL>' WHEN l_linenumber % 2 = 0 THEN substr(seq, 1, 1 + CAST(score % 3 AS INT)) ELSE substr(seq, 5, 1 + CAST(score % 3 AS INT)) END AS alt FROM {reads}"


def _allele_pairs(r):
    at = F.when(F.col("mapq") % 11 == 0, ".").when(F.col("mapq") % 13 == 0, "<DEL>").when(F.col("l_linenumber") % 2 == 0, F.substring("seq", F.lit(1), (F.col("score") % 3 + 1).cast("int"))).otherwise(F.substring("seq", F.lit(5), (F.col("score") % 3 + 1).cast("int")))
    return r.select(F.substring("seq", F.lit(1), F.col("mapq") % 3 + 1).alias("ref"), at.alias("alt")).distinct()


@query("q_variant_type", f"SELECT ref, alt, CASE WHEN alt = '.' THEN 'NO_VARIATION' WHEN alt LIKE '<%' THEN 'SYMBOLIC' WHEN length(ref) <> length(alt) THEN 'INDEL' WHEN length(ref) = 1 THEN 'SNP' ELSE 'MNP' END AS type FROM ({_AL})")
def _(r, spark, d):
    return _allele_pairs(r).select("ref", "alt", C.variant_type("ref", "alt").alias("type"))


@query("q_simple_indel", f"SELECT ref, alt, CASE WHEN length(ref) = length(alt) THEN NULL WHEN length(ref) = 1 AND starts_with(alt, ref) THEN 'insertion' WHEN length(alt) = 1 AND starts_with(ref, alt) THEN 'deletion' ELSE 'complex' END AS kind FROM ({_AL})")
def _(r, spark, d):
    return _allele_pairs(r).select("ref", "alt", C.simple_indel("ref", "alt").alias("kind"))


_KIND_SQL = "CASE WHEN {x} = '.' THEN 'NO_VARIATION' WHEN {x} LIKE '<%>' THEN 'SYMBOLIC' WHEN length(ref) <> length({x}) THEN 'INDEL' WHEN length(ref) = 1 THEN 'SNP' ELSE 'MNP' END"
_AL_TWO = f"SELECT ref, alt AS a, concat(alt, substr(ref, 1, 1)) AS b FROM ({_AL})"


@query("q_variant_types", f"""SELECT ref, a, b, CASE WHEN t = u THEN t ELSE 'MIXED' END AS type FROM (SELECT ref, a, b, {_KIND_SQL.replace('{x}', 'a')} AS t, {_KIND_SQL.replace('{x}', 'b')} AS u FROM ({_AL_TWO}))""")
def _(r, spark, d):
    x = _allele_pairs(r).select("ref", F.col("alt").alias("a"), F.concat("alt", F.substring("ref", 1, 1)).alias("b"))
    return x.select("ref", "a", "b", C.variant_types("ref", F.array("a", "b")).alias("type"))


# numbers --------------------------------------------------------------------------------------------------------------


@query("q_log_multinomial", "SELECT mapq, read_len, round(lgamma(mapq + read_len + 4) - lgamma(mapq + 1) - lgamma(read_len + 1) - lgamma(4), 6) AS ways, round(lgamma(read_len + 1), 6) AS log_factorial FROM (SELECT DISTINCT mapq, read_len FROM {reads})")
def _(r, spark, d):
    x = r.select("mapq", "read_len").distinct()
    return x.select("mapq", "read_len", F.round(C.log_multinomial("mapq", "read_len", F.lit(3)), 6).alias("ways"), F.round(C.log_factorial("read_len"), 6).alias("log_factorial"))


@query("q_reclip_cigar", """SELECT DISTINCT cigar, CASE WHEN regexp_full_match(cigar, '(\\d+[SHP])*') THEN '5M1D7M' ELSE concat(regexp_extract(cigar, '^(\\d+[SHP])*'), '5M1D7M', regexp_extract(cigar, '(\\d+[SHP])*$')) END AS clipped FROM {reads}""")
def _(r, spark, d):
    inner = C.cigar_ops(F.lit("5M1D7M"))
    return r.select("cigar").distinct().select("cigar", C.reclip_cigar(inner).alias("clipped"))


# reads against the reference ------------------------------------------------------------------------------------------

_FREE = "CASE l_linenumber % 4 WHEN 1 THEN substr({c}, 4) WHEN 3 THEN substr({c}, 1, read_len - 4) ELSE {c} END"
_MET = f"""(SELECT r.*, g.ref, {_FREE.replace('{c}', 'seq')} AS b, {_FREE.replace('{c}', 'qual')} AS q FROM {{reads}} r JOIN {{reference}} g USING (ref_id))"""
_KEYS = [*_LINE.split(", "), "score", "pos", "cigar"]
_WRONG = "CASE WHEN {at} + k >= 1100 THEN 99 WHEN substr(b, k + 1, 1) = 'N' OR substr(b, k + 1, 1) = substr(ref, {at} + k + 1, 1) THEN 0 ELSE ord(substr(q, k + 1, 1)) - 33 END"
_SUM = lambda at: f"CAST(list_sum(list_transform(range(0, length(b)), lambda k: {_WRONG.replace('{at}', at)})) AS INT)"


@query("q_mismatch_quality", f"SELECT {', '.join(_KEYS)}, {_SUM('pos')} AS mismatch_quality FROM {_MET}")
def _(r, spark, d):
    return measures.measured(r, derived.reference(spark), _KEYS, what=["mismatch_quality"]).select(*_KEYS, "mismatch_quality")


# places from one before to one after, as far as the stretch of reference around the read goes; the own one, then the smallest
_PLACES = ", ".join(f"CASE WHEN pos + {k} >= 0 AND ({k} <= 0 OR pos + length(b) + {k} <= 1100) THEN {_SUM(f'(pos + {k})') if k else _SUM('pos')} END" for k in (0, -1, 1))


@query("q_best_offset", f"""SELECT {', '.join(_KEYS)}, CAST(pos + [0, -1, 1][list_position(s, list_min(s))] AS INT) AS best_pos, list_min(s) AS best_quality FROM (SELECT *, [{_PLACES}] AS s FROM {_MET})""")
def _(r, spark, d):
    return measures.measured(r, derived.reference(spark), _KEYS, around=1, what=["best_pos", "best_quality"]).select(*_KEYS, "best_pos", "best_quality")


_OFFSET = "CASE l_linenumber % 4 WHEN 0 THEN i WHEN 1 THEN CASE WHEN i >= 3 THEN i - 3 END WHEN 2 THEN CASE WHEN i < 10 THEN i ELSE i + 2 END ELSE CASE WHEN i < 12 THEN i WHEN i > 12 AND i < read_len - 4 THEN i - 1 END END"
_DIFFERS = f"({_OFFSET}) IS NOT NULL AND pos + ({_OFFSET}) < 1100 AND substr(seq, i + 1, 1) <> substr(ref, pos + ({_OFFSET}) + 1, 1)"


@query("q_nm_uq", f"""SELECT {', '.join(_KEYS)}, CAST(coalesce(list_sum(list_transform(range(0, read_len), lambda i: CASE WHEN {_DIFFERS} THEN 1 ELSE 0 END)), 0) + CASE l_linenumber % 4 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS INT) AS nm,
 CAST(coalesce(list_sum(list_transform(range(0, read_len), lambda i: CASE WHEN {_DIFFERS} THEN ord(substr(qual, i + 1, 1)) - 33 ELSE 0 END)), 0) AS INT) AS uq FROM {_MET}""")
def _(r, spark, d):
    return measures.measured(r, derived.reference(spark), _KEYS, what=["nm", "uq"]).select(*_KEYS, "nm", "uq")


# how many bases in a row before the gap are equal to the one that a move by one brings to its other end
_DELETED = "CAST(coalesce(list_position(list_transform(range(0, 10), lambda k: substr(ref, pos + 10 - k, 1) = substr(ref, pos + 12 - k, 1)), false), 11) - 1 AS INT)"
_INSERTED = "CAST(coalesce(list_position(list_transform(range(0, 12), lambda k: substr(ref, pos + 12 - k, 1) = substr(seq, 12 - k, 1) AND substr(seq, 12 - k, 1) = substr(seq, 13 - k, 1)), false), 13) - 1 AS INT)"


@query("q_left_align", f"""SELECT {', '.join(_KEYS)}, CASE l_linenumber % 4 WHEN 2 THEN CASE WHEN m = 10 THEN concat(CAST(read_len AS VARCHAR), 'M') ELSE concat(CAST(10 - m AS VARCHAR), 'M2D', CAST(read_len - 10 + m AS VARCHAR), 'M') END
 WHEN 3 THEN concat(CASE WHEN m = 12 THEN '' ELSE concat(CAST(12 - m AS VARCHAR), 'M') END, '1I', CAST(read_len - 17 + m AS VARCHAR), 'M4S') ELSE cigar END AS left_aligned
 FROM (SELECT *, CASE l_linenumber % 4 WHEN 2 THEN {_DELETED} WHEN 3 THEN {_INSERTED} END AS m FROM {_MET})""")
def _(r, spark, d):
    return measures.measured(r, derived.reference(spark), _KEYS, what=["left_aligned"]).select(*_KEYS, "left_aligned")


# files as lines -------------------------------------------------------------------------------------------------------

_HEADER = Header(sequences=tuple({"SN": n, "LN": str(size)} for n, (_, size) in derived.SEQUENCES.items()))
_SAM_LINE = """concat_ws(chr(9), name, CAST(flag AS VARCHAR), CASE WHEN ref_id < 0 THEN '*' ELSE concat('chr', CAST(ref_id + 1 AS VARCHAR)) END, CAST(pos + 1 AS VARCHAR), CAST(mapq AS VARCHAR), cigar,
 CASE WHEN flag & 1 = 0 OR mate < 0 THEN '*' WHEN mate = ref_id THEN '=' ELSE concat('chr', CAST(mate + 1 AS VARCHAR)) END, CASE WHEN flag & 1 = 0 OR mate < 0 THEN '0' ELSE CAST(pos + 26 AS VARCHAR) END,
 CASE WHEN flag & 1 = 0 OR mate < 0 THEN '0' ELSE CAST(insert_size AS VARCHAR) END, seq, qual, concat('RG:Z:', rg), concat('NM:i:', CAST(score % 400 - 100 AS VARCHAR)))"""
_MATED = "(SELECT *, CASE WHEN ref_id < 0 THEN -1 ELSE (ref_id + l_linenumber % 2) % 5 END AS mate FROM {reads})"


def _with_mates(r):
    entry = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("value"))
    mate = F.when(F.col("ref_id") < 0, -1).otherwise((F.col("ref_id") + F.col("l_linenumber") % 2) % 5)
    number = F.col("score") % 400 - 100
    kind = F.when(number < -128, "s").when(number < 0, "c").when(number < 256, "C").otherwise("S")
    tags = F.create_map(F.lit("RG"), entry("Z", F.col("rg")), F.lit("NM"), F.struct(kind.alias("type"), number.cast("string").alias("value")))
    return r.withColumns({"idx": F.lit(0).cast("long"), "mate_ref_id": mate.cast("int"), "mate_pos": F.col("pos") + 25, "tags": tags})


@query("q_sam_lines", f"SELECT {_SAM_LINE} AS value FROM {_MATED}")
def _(r, spark, d):
    return sam.sam_lines(_with_mates(r), _HEADER).select("value")


@query("q_sam_parse", f"""SELECT name, flag, ref_id, pos, mapq, cigar, CAST(CASE WHEN flag & 1 = 0 THEN -1 ELSE mate END AS INT) AS mate_ref_id, CAST(CASE WHEN flag & 1 = 0 OR mate < 0 THEN -1 ELSE pos + 25 END AS INT) AS mate_pos,
 CAST(CASE WHEN flag & 1 = 0 OR mate < 0 THEN 0 ELSE insert_size END AS INT) AS insert_size, seq, qual, read_len, rg, CAST(score % 400 - 100 AS INT) AS nm,
 CASE WHEN score % 400 < -28 + 0 THEN 's' WHEN score % 400 < 100 THEN 'c' WHEN score % 400 < 356 THEN 'C' ELSE 'S' END AS nm_type FROM {_MATED}""")
def _(r, spark, d):
    x = sam.parse_lines(sam.sam_lines(_with_mates(r), _HEADER), _HEADER)
    return x.select("name", "flag", "ref_id", "pos", "mapq", "cigar", "mate_ref_id", "mate_pos", "insert_size", "seq", "qual", "read_len", C.tag("RG").alias("rg"), C.tag("NM").cast("int").alias("nm"), C.tag_type("NM").alias("nm_type"))


@query("q_coverage_tsv", f"SELECT concat_ws(chr(9), s.ref_name, CAST(100 * g.bin + 1 AS VARCHAR), CAST(c.coverage AS VARCHAR)) AS value FROM {{seqs}} s, (SELECT unnest(range(0, 11)) AS bin) g JOIN ({_BINS}) c ON c.ref_id = s.ref_id AND c.bin = g.bin")
def _(r, spark, d):
    return reports.coverage_lines(reports.coverage_table(r, derived.sequences(spark), zeros=False))


@query("q_flag_report", """SELECT ref_id, concat('Mapped reads:      ', lpad(CAST(count(*) FILTER (flag & 4 = 0) AS VARCHAR), 10, ' '), ' (', lpad(printf('%.1f', 100.0::DOUBLE * count(*) FILTER (flag & 4 = 0) / count(*)), 5, ' '), '%)') AS line FROM {reads} GROUP BY ref_id""")
def _(r, spark, d):
    share = F.format_string("%.1f", F.lit(100.0) * F.col("mapped") / F.col("total"))
    return stats.flagstat(r, ["ref_id"]).select("ref_id", F.concat(F.lit("Mapped reads:      "), F.lpad(F.col("mapped").cast("string"), 10, " "), F.lit(" ("), F.lpad(share, 5, " "), F.lit("%)")).alias("line"))


# the operators on groups of reads -------------------------------------------------------------------------------------


def _realigned(r, spark, d):
    x = _indexed(r).withColumns({"mate_ref_id": F.col("ref_id"), "mate_pos": F.lit(-1), "tags": F.create_map().cast(sam.TAGS)})
    return realign.realigned(x, derived.intervals(spark, d), derived.reference(spark), derived.sequences(spark))


@query("q_realign")
def _(r, spark, d):
    return _realigned(r, spark, d).select("idx", "name", "flag", "ref_id", "pos", "mapq", "cigar", "mate_ref_id", "mate_pos", "insert_size", C.tag("OC").alias("old_cigar"), C.tag("OP").alias("old_pos"))


def _loci(spark, d):
    at = derived.intervals(spark, d).join(derived.sequences(spark).select("ref_id", "ref_name"), "ref_id")
    text = lambda c: F.col(c).cast("string")
    region = F.concat("ref_name", F.lit(":"), text("start"), F.lit("-"), text("stop"))
    regions = at.withColumns({"start": F.col("start") + 1, "stop": F.col("start") + 12}).withColumns({"region": region, "second": F.concat(F.lit("3_4_1_100_"), text("start"), F.lit("_CAG")), "unit_length": F.lit(3), "unit": F.lit("CAG")})
    return repeats.loci(regions.drop("ref_id"), derived.reference(spark), derived.sequences(spark))


@query("q_repeat_loci", """SELECT concat('chr', CAST(ref_id + 1 AS VARCHAR), ':', CAST(start + 1 AS VARCHAR), '-', CAST(start + 12 AS VARCHAR)) AS region, substr(ref, greatest(start - 7, 1), least(start, 8)) AS left, substr(ref, start + 1, 12) AS center, substr(ref, start + 13, 8) AS right
 FROM {intervals} JOIN {reference} g USING (ref_id)""")
def _(r, spark, d):
    return _loci(spark, d).select("region", "left", "center", "right")


@query("q_genotype")
def _(r, spark, d):
    x = _indexed(r).withColumn("tags", F.create_map().cast(sam.TAGS))
    return repeats.genotypes(x, _loci(spark, d), left=0, right=0).select("region", "depth", "reads", "stars", "alleles", "concordance", "mean_mapq", "genotype", "confidence", "call_line", "report", F.array_join("vcf", "\n").alias("vcf"))
