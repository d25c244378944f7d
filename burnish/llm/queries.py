"""The corpus operators as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm.audit import filter_audit, flagged
from burnish.llm.bpe import decode_documents, encode_documents
from burnish.llm.chat import maximal_conversations
from burnish.llm.common import WORDS, read
from burnish.llm.embeddings import near_vectors
from burnish.llm.exact import exact_duplicates
from burnish.llm.jaccard import jaccard_components
from burnish.llm.mixing import mix
from burnish.llm.packing import pack_best_fit, token_pieces
from burnish.llm.quality import score_quality
from burnish.llm.records import read_records, write_records
from burnish.llm.repeats import remove_repeats
from burnish.llm.runs import periodic_runs
from burnish.llm.shards import shard_rows

Run = Callable[[SparkSession, str], DataFrame]
_RUNS: dict[str, Run] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        _RUNS[name] = run
        if sql:
            _SQL[name] = sql.strip()
        return run

    return add


def registered() -> dict[str, Run]:
    return dict(_RUNS)


def oracle() -> dict[str, str]:
    return dict(_SQL)


@query(
    "op10_exact_dedup",
    r"""
    with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
    select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
        doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
    from n
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents")).drop("row_no")


@query("op2_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(read(spark, sf_dir, "documents"), shards=16)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@query("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mix(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op7_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = encode_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return decode_documents(encoded, path).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_token_records")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = write_records(read(spark, sf_dir, "documents"), path, end_id=2)
    return read_records(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op4_embedding_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"), 0.98).drop("row_no")


@query(
    "op5_chat_formatting",
    """
    with placed as (
        select conv_id, role, text, row_number() over (partition by conv_id order by turn, role, text) as place
        from conversations),
    whole as (
        select conv_id, count(*) as n_turns, list({'r': role, 't': text} order by place) as turns,
            string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by place) as text
        from placed group by conv_id),
    grouped as (
        select min(conv_id) as conv_id, n_turns, count(*) as n_copies, turns, text from whole
        group by n_turns, turns, text)
    select conv_id, n_turns, n_copies, 0 as part, text from grouped a
    where not exists (
        select 1 from whole b where b.n_turns > a.n_turns and list_slice(b.turns, 1, a.n_turns) = a.turns)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_conversations(read(spark, sf_dir, "conversations"))


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(documents, read(spark, sf_dir, "labels")).drop("text")


@query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), width=4, share=85)


@query("op3_repeated_bytes")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(read(spark, sf_dir, "documents"), 50)
    removed = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return left.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query(
    "op11_filter_audit",
    r"""
    with cut as (
        select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
        from documents),
    marked as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
    failing as (
        select part, len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b,
            100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d,
            coalesce(cut.doc_id > min(cut.doc_id) over (partition by t), false) as e,
            coalesce(good, false) as good, coalesce(toxic, false) as toxic
        from cut left join marked using (doc_id)),
    masks as (
        select part, a, b, c, d, e, count(*) as n, count_if(good) as n_good, count_if(toxic) as n_toxic
        from failing group by all),
    letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
    orders as (
        select p.x || q.x || r.x || s.x || t.x as o
        from letters p, letters q, letters r, letters s, letters t
        where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
    removals as (
        select *, least(if(a, strpos(o, 'A'), 6), if(b, strpos(o, 'B'), 6), if(c, strpos(o, 'C'), 6),
            if(d, strpos(o, 'D'), 6), if(e, strpos(o, 'E'), 6)) as gone
        from masks, orders),
    steps as (
        select *, case substr(o, step, 1) when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end as fails,
            a::int + b::int + c::int + d::int + e::int as n_fails
        from removals, (select unnest([1, 2, 3, 4, 5])::integer as step)),
    audit as (
        select part, o as filter_order, step,
            coalesce(sum(n) filter (gone > step), 0)::bigint as kept,
            coalesce(sum(n) filter (gone = step), 0)::bigint as removed,
            coalesce(sum(n) filter (fails and gone < step), 0)::bigint as redundant,
            coalesce(sum(n) filter (fails and n_fails = 1), 0)::bigint as unique_fails,
            coalesce(sum(n_good) filter (gone = step), 0)::bigint as good_lost,
            coalesce(sum(n_toxic) filter (gone = step), 0)::bigint as toxic_lost
        from steps group by part, o, step)
    select *, (sum(removed) over (partition by part, substr(filter_order, step, 1)))::bigint as shapley from audit
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(flagged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


@query("op12_best_fit_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = token_pieces(read(spark, sf_dir, "documents"), path, 2048, end_id=0, with_ids=False)
    return pack_best_fit(pieces, 2048)


def looped(text: Column, doc_id: Column) -> Column:
    """The text of op13's contract: every tenth document repeats a stretch of its words to its end."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(crc / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words)
        first = (g % n).cast("int")
        period = (1 + F.floor((n - first) / (3 + g % 8))).cast("int")
        again = F.transform(F.sequence(first, n - 1), lambda i: F.element_at(words, 1 + first + (i - first) % period))
        return F.array_join(F.concat(F.slice(words, 1, first), again), " ")

    # An array of one array, so that the words are cut once and not for each of them again.
    whole = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))), rewritten)
    return F.when((crc % 10 == 0) & (F.regexp_count(text, F.lit(WORDS)) > 0), F.get(whole, F.lit(0))).otherwise(text)


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text"))
    # The greatest run: the longest, then the leftmost, then that of the smallest period.
    before = lambda x, y: F.when((x["length"] > y["length"]) | ((x["length"] == y["length"]) & (F.struct(x["start"], x["period"]) < F.struct(y["start"], y["period"]))), x).otherwise(y)
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"], F.lit("\n")))))
    return periodic_runs(docs).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: before(x, y)).alias("best"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
