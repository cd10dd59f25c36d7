"""The corpus operators' queries over whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import class_ngrams, decontamination, language_id, suffix_dedup, token_output
from pathloom.llm.chat import events_of_turns, format_conversations, summary
from pathloom.llm.exact_dedup import exact_dedup
from pathloom.llm.packing import pack_documents
from pathloom.llm.simhash import simhash_groups
from pathloom.llm.tokens import default_path
from pathloom.llm.url_filter import url_filter
from pathloom.shared import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, if there is one, its SQL."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op8_exact_dedup",
    r"""
    with n as (select doc_id, length(coalesce(text, '')) as chars,
                      regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
         g as (select *, count(*) over (partition by norm) as group_size,
                      first_value(doc_id) over (partition by norm order by chars desc, doc_id) as keep_id from n)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g
    """,
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with the document that stays for it."""
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


#: A conversation that says the template's own marks.
MARKED = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]


@query("op3_chat_format")
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from the formatted text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame(MARKED, turns.schema)
    return summary(format_conversations(events_of_turns(turns.unionByName(marked))), ordered=True)


#: The rules (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query(
    "op4_url_filter",
    r"""
    with u as (select page_id, case when contains(url, '://') then url else '' end as url from pages),
         r as (select page_id, substr(url, strpos(url, '://') + 3) as rest from u),
         h as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from r),
         p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                      regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
         rules(host, path, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
         hits as (select p.page_id, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) as best
                  from p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by p.page_id)
    select p.page_id, p.host, p.path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from p left join hits using (page_id)
    """,
)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    # A relation of constants: rows of a Python list would come through Python.
    rules = spark.sql("select * from values " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + " as rules(host, path, verdict)")
    judged = url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


@query("op5_simhash_groups")
def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = simhash_groups(table(spark, sf_dir, "documents"), size=4, budget=4)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    packed = pack_documents(table(spark, sf_dir, "documents"), default_path(), 1024)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; four in five documents may train."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    judged = language_id.identify(docs.select("doc_id", "text"), model)
    return judged.select(F.col("row.doc_id").alias("doc_id"), language_id.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query("op9_class_ngrams")
def op9_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under the class model and the unigram."""
    return class_ngrams.score_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, with its edits."""
    found = decontamination.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    each = found.select(F.col("row.doc_id").alias("doc_id"), F.explode("matches").alias("m"))
    return each.select("doc_id", "m.item_id", "m.edits", "m.start")


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated strings leaves of every document."""
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op1_training_order")
def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence's slot and digest, read back from the written shards.

    doc_id, piece, slot, shard, byte_offset (in the shard), length, ids_sha256 (of its ids as
    unsigned 16-bit numbers).
    """
    out = new_path(spark, "training-order")
    total = token_output.write_training_order(table(spark, sf_dir, "documents"), default_path(), out)
    if not total:
        return spark.createDataFrame([], "doc_id long, piece int, slot long, shard long, byte_offset long, length int, ids_sha256 string")
    found = token_output.read_training_order(spark, out)
    return found.select(
        F.col("id").alias("doc_id"), "piece", "slot", F.floor(F.col("slot") / token_output.SHARD_RECORDS).alias("shard"),
        (F.col("slot") % token_output.SHARD_RECORDS * token_output.stride()).alias("byte_offset"), "length", F.sha2("ids", 256).alias("ids_sha256"),
    )
