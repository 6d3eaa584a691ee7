"""The registered queries of the text operators, each over its whole tables."""

from __future__ import annotations

from emberwatch.llm import (
    chat, decontamination, exact_dedup, language, licences, merkle, packing, personal, quality, secrets,
    simhash, token_store, vector_codes,
)
from emberwatch.llm.common import table
from emberwatch.llm.registry import REGISTRY, SQL, query
from emberwatch.session import scratch_path

__all__ = ["REGISTRY", "SQL"]


@query
def op1_benchmark_decontamination(spark, sf_dir):
    return decontamination.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query
def op5_chat_formatting(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(
        "select -7L as conv_id, turn, role, :said as text "
        "from values (0L, 'user'), (1L, 'assistant') as t(turn, role)", args={"said": said}
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.describe(chat.format_conversations(rows.unionByName(own)))


SQL["op5_chat_formatting"] = chat.SQL


@query
def op6_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op7_simhash_near_dedup(spark, sf_dir):
    found = simhash.clusters(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", simhash.hexadecimal("print").alias("fingerprint"), "component_id"
    )


@query
def op8_quality_rules(spark, sf_dir):
    judged = quality.score_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )
    return judged.select("doc_id", *quality.BASE, "kept")


SQL["op8_quality_rules"] = quality.SQL


@query
def op2_licence_scans(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents")).drop("notice")


@query
def op3_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op4_token_store(spark, sf_dir):
    path = scratch_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path)
    return token_store.describe_store(spark, path)


@query
def op9_personal_data(spark, sf_dir):
    return personal.describe(personal.find(table(spark, sf_dir, "documents")))


@query
def op10_secret_scans(spark, sf_dir):
    return secrets.describe(secrets.scan(table(spark, sf_dir, "documents")))


@query
def op11_merkle_manifest(spark, sf_dir):
    return merkle.audit(table(spark, sf_dir, "documents"), merkle.lower_some)


SQL["op11_merkle_manifest"] = merkle.SQL


@query
def op12_vector_codes(spark, sf_dir):
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


SQL["op12_vector_codes"] = vector_codes.SQL


@query
def op13_exact_dedup(spark, sf_dir):
    """The documents as two loads, large ids first, into a new index."""
    docs = table(spark, sf_dir, "documents")
    index = exact_dedup.create_index(
        spark, scratch_path(spark, "digest-index"), exact_dedup.buckets_for(docs.count())
    )
    loads = [exact_dedup.absorb(index, part, f"load {i}")
             for i, part in enumerate(exact_dedup.newest_first(docs, 2))]
    return exact_dedup.report(index, loads)


SQL["op13_exact_dedup"] = exact_dedup.SQL
