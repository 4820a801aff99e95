"""Queries of the item tree: regions are seeds, nations, customers and orders their children, and the crawl as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.operators import metrics, tree
from dredge.plans.base import table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    node = lambda i, p, k: (F.concat(F.lit(i), k.cast("string")).alias("item_id"), p.alias("parent_id"))
    none = F.lit(None).cast("string")
    of = lambda letter, k: F.concat(F.lit(letter), k.cast("string"))
    c = F.col
    customers = t("customer").select("c_custkey", F.concat(F.lit("r"), (c("c_nationkey") % 5).cast("string")).alias("x"), "c_nationkey")
    nations = t("nation")
    rows = (
        t("region").select(*node("r", none, c("r_regionkey")), of("r", c("r_regionkey")).alias("seed_id"), F.lit("GotChildren").alias("status"), c("r_regionkey").cast("long").alias("k"))
        .unionByName(nations.select(*node("n", of("r", c("n_regionkey")), c("n_nationkey")), of("r", c("n_regionkey")).alias("seed_id"), F.when(c("n_nationkey") % 3 == 0, "GotRedirected").otherwise("GotChildren").alias("status"), c("n_nationkey").cast("long").alias("k")))
        .unionByName(customers.join(nations, c("c_nationkey") == c("n_nationkey")).select(*node("c", of("n", c("c_nationkey")), c("c_custkey")), of("r", c("n_regionkey")).alias("seed_id"), F.when(c("c_custkey") % 10 == 0, "Fresh").when(c("c_custkey") % 10 == 1, "Seen").otherwise("Completed").alias("status"), c("c_custkey").cast("long").alias("k")))
    )
    return rows.withColumn("url", F.concat(F.lit("http://h/"), (F.col("k") % 40).cast("string"))).withColumn("seed_via", F.lit("")).withColumn("source", F.lit("Queue"))


def tree_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.with_depth(_items(spark, sf_dir)).select("item_id", F.col("depth").cast("long").alias("depth"), F.col("plain_depth").cast("long").alias("plain_depth"), "path")


def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.roots(tree.with_depth(_items(spark, sf_dir)))


def tree_max_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.max_depth(tree.with_depth(_items(spark, sf_dir))).select("seed_id", F.col("max_depth").cast("long").alias("max_depth"))


def tree_deepest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.deepest(tree.with_depth(_items(spark, sf_dir))).select("item_id", "seed_id")


def tree_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.dedupe(tree.with_depth(_items(spark, sf_dir))).select("item_id", "seed_id", "url", "status")


def tree_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.complete(_items(spark, sf_dir)).select("item_id", "status")


def tree_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.relations(_items(spark, sf_dir))


def tree_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.violations(_items(spark, sf_dir))


def children_captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.children_captured(_items(spark, sf_dir))


def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest hops, up to 4, from page 0 over a static link graph of all pages, by rounds of joins."""
    n = table(spark, sf_dir, "pages").count()
    links = table(spark, sf_dir, "pages").select(F.col("page_id").alias("src"), F.explode(F.array((F.col("page_id") * 7 + 1) % n, (F.col("page_id") * 3 + 2) % n)).alias("dst"))
    best = table(spark, sf_dir, "pages").where("page_id = 0").select("page_id", F.lit(0).cast("long").alias("hops"))
    for _ in range(4):
        step = best.join(links, best["page_id"] == links["src"]).select(F.col("dst").alias("page_id"), (F.col("hops") + 1).alias("hops"))
        best = best.unionByName(step).groupBy("page_id").agg(F.min("hops").alias("hops"))
    return best


_I = """i AS (SELECT *, 'http://h/' || k % 40 AS url FROM (
  SELECT 'r' || r_regionkey AS item_id, NULL AS parent_id, 'r' || r_regionkey AS seed_id, 'GotChildren' AS status, r_regionkey AS k FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'r' || n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN 'GotRedirected' ELSE 'GotChildren' END, n_nationkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'r' || n_regionkey, CASE c_custkey % 10 WHEN 0 THEN 'Fresh' WHEN 1 THEN 'Seen' ELSE 'Completed' END, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey))"""
_T = _I + """, t(item_id, depth, plain_depth, path) AS (SELECT item_id, 0, CASE WHEN status = 'GotRedirected' THEN -1 ELSE 0 END, item_id FROM i WHERE parent_id IS NULL
  UNION ALL SELECT i.item_id, t.depth + 1, t.plain_depth + CASE WHEN i.status = 'GotRedirected' THEN 0 ELSE 1 END, t.path || '/' || i.item_id FROM t JOIN i ON i.parent_id = t.item_id)"""
QUERIES = {
    "tree_depths": (tree_depths, f"WITH RECURSIVE {_T} SELECT item_id, depth::BIGINT AS depth, plain_depth::BIGINT AS plain_depth, path FROM t"),
    "tree_roots": (tree_roots, f"WITH RECURSIVE {_T} SELECT item_id, string_split(path, '/')[1] AS root FROM t"),
    "tree_max_depth": (tree_max_depth, f"WITH RECURSIVE {_T} SELECT seed_id, max(depth)::BIGINT AS max_depth FROM t JOIN i USING (item_id) GROUP BY 1"),
    "tree_deepest": (tree_deepest, f"WITH RECURSIVE {_T}, m AS (SELECT seed_id, item_id, depth, max(depth) OVER (PARTITION BY seed_id) AS x FROM t JOIN i USING (item_id)) SELECT item_id, seed_id FROM m WHERE depth = x"),
    "tree_dedupe": (tree_dedupe, f"WITH RECURSIVE {_T}, d AS (SELECT i.*, row_number() OVER (PARTITION BY seed_id, url, parent_id IS NULL ORDER BY (CASE WHEN status = 'Completed' THEN 0 ELSE 1 END), path) AS n FROM t JOIN i USING (item_id)) SELECT item_id, seed_id, url, status FROM d WHERE n = 1 OR parent_id IS NULL"),
    "tree_complete": (tree_complete, f"""WITH {_I}, a AS (SELECT i.item_id, i.parent_id, CASE WHEN i.status IN ('GotChildren', 'GotRedirected') AND i.item_id LIKE 'n%' AND NOT EXISTS (SELECT 1 FROM i c WHERE c.parent_id = i.item_id AND c.status NOT IN ('Completed', 'Seen', 'Failed')) THEN 'Completed' ELSE i.status END AS status FROM i)
        SELECT item_id, CASE WHEN item_id LIKE 'r%' AND NOT EXISTS (SELECT 1 FROM a c WHERE c.parent_id = a.item_id AND c.status NOT IN ('Completed', 'Seen', 'Failed')) THEN 'Completed' ELSE status END AS status FROM a"""),
    "tree_relations": (tree_relations, f"""WITH {_I}, n AS (SELECT parent_id AS item_id, count(*) AS c FROM i WHERE parent_id IS NOT NULL GROUP BY 1)
        SELECT i.item_id, coalesce(n.c, 0) AS n_children, i.parent_id IS NULL AS is_seed, coalesce(p.status = 'GotChildren', false) AS is_child, coalesce(p.status = 'GotRedirected', false) AS is_redirection, coalesce(n.c, 0) = 1 AND i.status = 'GotRedirected' AS has_redirection
        FROM i LEFT JOIN n USING (item_id) LEFT JOIN i p ON p.item_id = i.parent_id"""),
    "tree_violations": (tree_violations, f"""WITH {_I}, n AS (SELECT parent_id AS item_id, count(*) AS c FROM i WHERE parent_id IS NOT NULL GROUP BY 1) SELECT item_id, 'redirect with several children' AS rule FROM i JOIN n USING (item_id) WHERE c > 1 AND status = 'GotRedirected'"""),
    "children_captured": (children_captured, f"WITH {_I} SELECT seed_id, count(*) FILTER (parent_id IS NOT NULL AND status IN ('Archived', 'Completed', 'GotChildren', 'GotRedirected')) AS children FROM i GROUP BY 1"),
    "reachable_pages": (reachable, """WITH RECURSIVE c AS (SELECT count(*) AS n FROM pages), l AS (SELECT page_id AS src, (page_id * 7 + 1) % n AS dst FROM pages, c UNION ALL SELECT page_id, (page_id * 3 + 2) % n FROM pages, c),
        w(page_id, hops) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT dst, hops + 1 FROM w JOIN l ON src = page_id WHERE hops < 4) SELECT page_id, min(hops) AS hops FROM w GROUP BY 1"""),
}
