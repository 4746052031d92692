"""Queries on sources, validity and report parts, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import enrichment as X
from tessera.operators import knowledge as K
from tessera.operators import outline
from tessera.operators import taxonomy as T
from tessera.operators import text as TX
from tessera.plans import knowledge_views as V
from tessera.plans import report
from tessera.session import fresh_path, stored, table
from tessera.sources import io

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_HEADS = """SELECT 'n' || p_partkey AS path, '---' || chr(10) || 'fund:' || chr(10) || '  name: "[' || p_name || ']" # short' || chr(10) || '  managers:' || chr(10) || '    - name: A' || p_partkey % 5 || chr(10) || '      since: ' || (2000 + p_partkey % 20) || chr(10)
  || '    - name: B' || chr(10) || '      tags: [x, "y, z", w' || p_partkey % 3 || ']' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'codes:' || chr(10) || '- ' || p_partkey || chr(10) || '- - 7' || chr(10) || '  - 8' || chr(10) ELSE '' END || '# remark' || chr(10) || 'note: plain' || chr(10) || '---' || chr(10) || 'text: no field' AS content FROM part"""


@query("""WITH k AS (SELECT p_partkey AS k, p_name FROM part)
SELECT 'n' || k AS path, 'fund.name' AS field, '[' || p_name || ']' AS value FROM k UNION ALL SELECT 'n' || k, 'fund.managers.0.name', 'A' || k % 5 FROM k UNION ALL SELECT 'n' || k, 'fund.managers.0.since', CAST(2000 + k % 20 AS VARCHAR) FROM k
UNION ALL SELECT 'n' || k, 'fund.managers.1.name', 'B' FROM k UNION ALL SELECT 'n' || k, 'fund.managers.1.tags.' || i, v FROM k, LATERAL (VALUES (0, 'x'), (1, 'y, z'), (2, 'w' || k % 3)) AS t(i, v)
UNION ALL SELECT 'n' || k, 'codes.' || i, v FROM k, LATERAL (VALUES ('0', CAST(k AS VARCHAR)), ('1.0', '7'), ('1.1', '8')) AS t(i, v) WHERE k % 2 = 0 UNION ALL SELECT 'n' || k, 'note', 'plain' FROM k""")
def note_fields(spark, sf):
    return outline.head_fields(spark.sql(_HEADS.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part")))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_name END, 'nobody') AS c_name, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS c_acctbal FROM customer""")
def jsonl_tables(spark, sf):
    """Customers written as JSON lines, missing values left out of the lines, and read back with a default."""
    path = fresh_path(spark, "jsonl")
    io.write_jsonl(table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")).alias("c_acctbal")), path)
    return io.read_jsonl(spark, path, "c_custkey long, c_name string, c_acctbal double", {"c_name": F.lit("nobody")})


_CELL = "SELECT 's' || p_partkey % 3 AS sheet, 'A' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS cell, CASE p_partkey % 9 WHEN 0 THEN ' #REF! ' WHEN 1 THEN '#N/A' WHEN 2 THEN '#DIV/0!' WHEN 3 THEN '#OTHER!' ELSE CAST(p_partkey AS VARCHAR) END AS value FROM part"


@query(f"""WITH c AS (SELECT trim(value) AS error, sheet || '!' || cell AS place FROM ({_CELL}) WHERE trim(value) IN ('#REF!', '#N/A', '#DIV/0!')), r AS (SELECT *, row_number() OVER (PARTITION BY error ORDER BY place) AS n FROM c)
SELECT error, count(*) AS n, string_agg(place, '|' ORDER BY place) FILTER (n <= 20) AS places FROM r GROUP BY 1""")
def sheet_errors(spark, sf):
    t = io.cell_errors(spark.sql(_CELL.replace("VARCHAR", "STRING").replace("FROM part", "FROM {part}"), part=table(spark, sf, "part")))
    return t.withColumn("places", F.array_join("places", "|"))


@query("""SELECT CASE WHEN p_brand LIKE '%1' THEN 'csv' ELSE 'txt' END AS kind, count(DISTINCT p_brand) AS files, CASE WHEN p_brand LIKE '%1' THEN 'other' ELSE 'text_note' END AS category, true AS hashed FROM part GROUP BY 1, 3""")
def catalogue_scan(spark, sf):
    """A folder of files, one a brand, as a catalogue with categories and digests."""
    path = fresh_path(spark, "scanned")
    p = table(spark, sf, "part").select("p_brand", F.concat_ws(",", "p_partkey", "p_name").alias("value"))
    ends_in_one = F.col("p_brand").endswith("1")
    p.where(ends_in_one).repartition("p_brand").write.partitionBy("p_brand").csv(f"{path}/csv")
    p.where(~ends_in_one).repartition("p_brand").write.partitionBy("p_brand").text(f"{path}/txt")
    t = io.catalogue(spark, path, [".csv", ".txt"])
    return t.groupBy(F.substring("suffix", 2, 9).alias("kind"), "category").agg(F.count(F.lit(1)).alias("files"), F.min(F.length("sha256") == 64).alias("hashed"))


@query(f"""WITH {V.PROFILES_CTE}, g AS (SELECT manager, primary_tag AS family, id FROM profiles WHERE id % 6 = 0), r AS (SELECT DISTINCT manager, primary_tag AS family, product_name AS canonical_key FROM profiles WHERE id % 36 BETWEEN 1 AND 3)
SELECT g.id AS id, g.manager AS manager, g.family AS family, r.canonical_key AS target_key FROM g JOIN r ON g.manager = r.manager AND g.family = r.family""")
def group_attach(spark, sf):
    p = V.profiles(spark, sf).select("id", "manager", F.col("primary_tag").alias("family"), "product_name")
    p = stored(p.where("id % 6 = 0 OR id % 36 BETWEEN 1 AND 3"), "attached")  # read several times
    return K.attached(p.where("id % 6 = 0").drop("product_name"), p.where("id % 36 BETWEEN 1 AND 3").select("manager", "family", F.col("product_name").alias("canonical_key")).distinct(), ["manager", "family"]).select("id", "manager", "family", "target_key")


@query(r"""WITH t AS (SELECT doc_id, trim(coalesce(text, ''), ' ') AS t FROM documents),
l AS (SELECT doc_id, trim(unnest(string_split(t, chr(10))), ' ') AS line FROM t), c AS (SELECT doc_id, line, count(*) AS n FROM l WHERE length(line) BETWEEN 2 AND 24 GROUP BY 1, 2),
r AS (SELECT doc_id, sum(CASE WHEN n >= 3 THEN n ELSE 0 END) / sum(n) AS repeated FROM c GROUP BY 1)
SELECT t.doc_id AS doc_id, length(t) >= 50 AND length(t) / 1.0 >= 30 AND length(regexp_replace(t, '[^\p{L}\p{N}\s.,;:!?%()\-，。；：！？（）、]', '', 'g')) / greatest(length(t), 1) >= 0.30 AND coalesce(repeated, 0) <= 0.28 AS valid FROM t LEFT JOIN r ON t.doc_id = r.doc_id""")
def document_validity(spark, sf):
    return table(spark, sf, "documents").select("doc_id", TX.is_valid(F.col("text")).alias("valid"))


@query("""WITH e AS (SELECT event_id AS id, ['beta', 'momentum', 'odd'][1 + event_id % 3] AS factor, CASE WHEN event_id % 17 = 0 THEN NULL ELSE (event_id % 9 - 4) / 10.0 END AS x FROM events)
SELECT id, CASE WHEN x IS NULL THEN '-' WHEN abs(x) < 0.1 THEN '中性' WHEN x > 0 THEN CASE factor WHEN 'beta' THEN '高贝塔' WHEN 'momentum' THEN '追随动量' ELSE '正暴露' END ELSE CASE factor WHEN 'beta' THEN '低贝塔' WHEN 'momentum' THEN '逆动量' ELSE '负暴露' END END AS hint FROM e""")
def factor_hints(spark, sf):
    """Phrases by factor and sign of an exposure."""
    factor = F.element_at(F.array(F.lit("beta"), F.lit("momentum"), F.lit("odd")), (1 + F.col("event_id") % 3).cast("int"))
    x = F.when(F.col("event_id") % 17 != 0, (F.col("event_id") % 9 - 4) / 10.0)
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), report.factor_hint(factor, x).alias("hint"))


@query("""WITH s AS (SELECT sum(c_acctbal) / 1e6 AS explained FROM customer) SELECT n_nationkey AS id, round(n_nationkey / 10.0 - explained, 6) AS residual FROM nation, s""")
def interval_residual(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") / 10.0).alias("interval_return"))
    got = report.residual(n, table(spark, sf, "customer").select((F.col("c_acctbal") / 1e6).alias("contribution")))
    return got.select("id", F.round("residual", 6).alias("residual"))


@query(f"""WITH {V.PROFILES_CTE} SELECT id, CASE WHEN contains(lower(evidence_line), 'cta') THEN evidence_line WHEN contains(lower(profile_text), 'cta') THEN profile_text WHEN contains(evidence_line, '行业') THEN evidence_line WHEN contains(profile_text, '行业') THEN profile_text
  WHEN evidence_line <> '' THEN evidence_line WHEN profile_text <> '' THEN profile_text ELSE product_name END AS snippet FROM profiles""")
def snippets(spark, sf):
    return V.profiles(spark, sf).select("id", X.snippet(F.array("evidence_line", "profile_text"), F.array(F.lit("CTA"), F.lit("行业")), F.col("product_name")).alias("snippet"))


@query(f"""WITH {V.PROFILES_CTE}, p AS (SELECT id, ['u' || id % 3, 'u' || id % 4, 'u1'] AS urls FROM profiles) SELECT id, (SELECT string_agg(u, '|' ORDER BY o) FROM (SELECT u, min(o) AS o FROM (SELECT unnest(urls) AS u, unnest(range(3)) AS o) GROUP BY 1)) AS urls FROM p""")
def evidence_merge(spark, sf):
    """External evidence of two lists, each item once."""
    item = lambda u: F.create_map(F.lit("url"), u, F.lit("title"), F.lit("t"))
    a, b = F.array(item(F.concat(F.lit("u"), F.col("id") % 3))), F.array(item(F.concat(F.lit("u"), F.col("id") % 4)), item(F.lit("u1")))
    return V.profiles(spark, sf).select("id", F.array_join(F.transform(X.merged_external(a, b), lambda m: m["url"]), "|").alias("urls"))


@query(f"""WITH {V.PROFILES_CTE} SELECT id, coalesce(array_to_string(list_distinct(regexp_extract_all(evidence_line || ' ' || profile_text, '([一-鿿A-Za-z0-9]{{0,12}}{T.CANDIDATE_STEMS[0]}[一-鿿A-Za-z0-9]{{0,12}})', 1)), '|'), '') AS terms FROM profiles""")
def candidate_terms(spark, sf):
    """What stands round the first stem of candidate tags."""
    t = T.classified(V.profiles(spark, sf).select("id", F.concat_ws(" ", "evidence_line", "profile_text").alias("text")))
    named = F.filter("candidate_tags", lambda x: x.contains(T.CANDIDATE_STEMS[0]) & F.col("text").contains(x))
    return t.select("id", F.array_join(named, "|").alias("terms"))
