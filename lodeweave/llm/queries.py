"""Registered queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import credentials, generated, matching, names, packing, reading, syntax, tokens
from lodeweave.runtime import read_table


def _credential_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [read_table(spark, d, t) for t in ("scanned_files", "repositories", "stored_procedures")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find_credentials(*_credential_tables(spark, d)).select("source_table", "record_id", "line_no").distinct()


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    return credentials.masked_lines(*_credential_tables(spark, d))


def p1_leaks(spark: SparkSession, d: str) -> DataFrame:
    """One row: masked lines that still hold a confirmed value, and masked lines with a long run of a key's text that no mark of a block is."""
    t = _credential_tables(spark, d)
    m = credentials.masked_lines(*t)
    v = credentials.find_credentials(*t).where(~F.col("value").startswith("key block "))
    held = v.join(m, ["source_table", "record_id", "line_no"]).agg(F.count_if(F.expr("contains(masked_line, value)")).alias("leaks"))
    keys = m.agg(F.count_if(F.col("masked_line").contains("PRIVATE KEY-----") & F.rlike(F.regexp_replace("masked_line", "-----[A-Z ]+-----", " "), F.lit("[A-Za-z0-9+/=]{40,}"))).alias("key_lines"))
    return held.crossJoin(F.broadcast(keys))  # two single rows


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return matching.match(read_table(spark, d, "classes"), read_table(spark, d, "catalog_columns")).select("class_id", "table_id")


def p2_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate pair with its marginal probability."""
    return matching.marginals(read_table(spark, d, "classes"), read_table(spark, d, "catalog_columns")).withColumn("probability", F.round("probability", 4))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(names.link_names(read_table(spark, d, "authors"), scored=False))


def p3_identities(spark: SparkSession, d: str) -> DataFrame:
    """Membership in place of pairs: every row with its identity and the rarity of what it shares."""
    return names.link_names(read_table(spark, d, "authors"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return generated.find_generated(read_table(spark, d, "scanned_files")).where("is_generated").select("file_id")


def p5_judged(spark: SparkSession, d: str) -> DataFrame:
    """Every file that was judged, and whether the forest's probability and its decision agree."""
    g = generated.find_generated(read_table(spark, d, "scanned_files"))
    return g.select("file_id", ((F.col("probability") >= 0.5) == F.col("is_generated")).alias("agrees"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.check_files(read_table(spark, d, "scanned_files")).where("not is_valid").select("file_id")


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(syntax.check_files(read_table(spark, d, "scanned_files")))


def p7_files(spark: SparkSession, d: str) -> DataFrame:
    """Files judged per repository and language, from the rates."""
    return syntax.rates(syntax.check_files(read_table(spark, d, "scanned_files"))).select("repo", "language", "n_files")


def p7_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Files that do not parse because a merge was never finished."""
    return syntax.check_files(read_table(spark, d, "scanned_files")).where("cause = 'conflict'").select("file_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(read_table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The digest of every document's bytes, put together again from its ids."""
    return tokens.decode(tokens.encode(read_table(spark, d, "documents"))).select("doc_id", F.md5("content").alias("digest"))


def p9_packs(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, d, "documents"), capacity=2048)


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents, those without a token, packs over the capacity, items that overlap or leave a gap, texts cut without need."""
    p = packing.pack_documents(read_table(spark, d, "documents"), capacity=2048)
    at = F.array_sort(F.collect_list(F.struct("pack_offset", "n_tokens")))  # of one pack: at most its capacity
    packs = p.where("pack_id is not null").groupBy("pack_id").agg(F.sum("n_tokens").alias("fill"), at.alias("at"))
    gap = F.aggregate("at", F.struct(F.lit(0).cast("bigint").alias("next"), F.lit(0).alias("wrong")), lambda a, x: F.struct((x["pack_offset"] + x["n_tokens"]).cast("bigint").alias("next"), (a["wrong"] + (x["pack_offset"] != a["next"]).cast("int")).alias("wrong")), lambda a: a["wrong"])
    per_pack = packs.agg(F.count_if(F.col("fill") > 2048).alias("overfull"), F.coalesce(F.sum(gap), F.lit(0)).alias("misplaced"))
    per_doc = p.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces")).agg(F.count("*").alias("documents"), F.count_if(F.col("n") == 0).alias("without_tokens"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= 2048)).alias("cut_without_need"))
    return per_doc.crossJoin(F.broadcast(per_pack))  # two single rows


def _reading_model(spark: SparkSession, d: str) -> reading.ReadingModel:
    return reading.fit(read_table(spark, d, "documents"), read_table(spark, d, "reading_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.grade(read_table(spark, d, "documents"), _reading_model(spark, d)).where("is_expert").select("doc_id")


def p10_graded(spark: SparkSession, d: str) -> DataFrame:
    """Which documents have a level."""
    return reading.grade(read_table(spark, d, "documents"), _reading_model(spark, d)).select("doc_id", F.col("reading_level").isNotNull().alias("has_level"))


def p10_cross_validation(spark: SparkSession, d: str) -> DataFrame:
    """By source: rated documents, mean error and accuracy of grades predicted for unseen folds."""
    return spark.createDataFrame(_reading_model(spark, d).report, "source string, n bigint, mean_error double, accuracy double")


QUERIES = {
    "p1_found": p1_found, "p1_masked": p1_masked, "p1_leaks": p1_leaks, "p2_found": p2_found, "p2_confidence": p2_confidence, "p3_found": p3_found, "p3_identities": p3_identities, "p5_found": p5_found, "p5_judged": p5_judged, "p7_found": p7_found, "p7_rates": p7_rates, "p7_files": p7_files, "p7_conflicts": p7_conflicts,
    "p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p9_packs": p9_packs, "p9_report": p9_report, "p10_found": p10_found, "p10_graded": p10_graded, "p10_cross_validation": p10_cross_validation,
}
#: What SQL can say of the operators: exact round trips and invariants.
SQL: dict[str, str] = {
    "p1_leaks": "SELECT 0 AS leaks, 0 AS key_lines", "p5_judged": "SELECT file_id, true AS agrees FROM scanned_files WHERE code_lines IS NOT NULL",
    "p7_files": "SELECT repo, file_type AS language, count(*) AS n_files FROM scanned_files WHERE file_type IN ('python', 'java', 'typescript', 'javascript', 'go', 'json', 'xml', 'sql') AND code_lines IS NOT NULL GROUP BY ALL",
    "p7_conflicts": "SELECT file_id FROM scanned_files WHERE file_type IN ('python', 'java', 'typescript', 'javascript', 'go', 'json', 'xml', 'sql') AND len(list_filter(code_lines, lambda x: starts_with(x.line_text, '<<<<<<< ') OR starts_with(x.line_text, '>>>>>>> '))) > 0",
    "p8_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p9_report": "SELECT count(*) AS documents, count(*) FILTER (WHERE coalesce(text, '') = '') AS without_tokens, 0 AS cut_without_need, 0 AS overfull, 0 AS misplaced FROM documents",
    "p10_graded": "SELECT doc_id, text IS NOT NULL AND NOT regexp_full_match(text, '\\s*') AS has_level FROM documents",
}
