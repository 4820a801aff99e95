"""Item trees as an adjacency list: levels, depths, dedupe, completion, consistency.

Depth is unbounded, so nothing is nested; closures are recursive SQL or rounds of joins that end when
nothing changes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dredge.operators.store import written
from dredge.schemas import FINAL, SOURCES, STATES


def with_depth(items: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """items plus depth (from the seed), plain_depth (redirecting items add nothing) and path (pre-order key)."""
    name = "__items_" + str(abs(hash(items.semanticHash())))
    items.createOrReplaceTempView(name)
    spark = items.sparkSession
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(max_depth))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    found = spark.sql(f"""
        WITH RECURSIVE t(item_id, depth, plain_depth, path) AS (
            SELECT item_id, 0, CASE WHEN status = 'GotRedirected' THEN -1 ELSE 0 END, item_id FROM {name} WHERE parent_id IS NULL
            UNION ALL
            SELECT i.item_id, t.depth + 1, t.plain_depth + CASE WHEN i.status = 'GotRedirected' THEN 0 ELSE 1 END, concat(t.path, '/', i.item_id)
            FROM t JOIN {name} i ON i.parent_id = t.item_id
        ) SELECT * FROM t""")
    return items.join(found, "item_id")


def max_depth(items: DataFrame) -> DataFrame:
    """(seed_id, max_depth) of items with depth."""
    return items.groupBy("seed_id").agg(F.max("depth").alias("max_depth"))


def deepest(items: DataFrame) -> DataFrame:
    """Items at the greatest depth of their seed: the level that a pass works on."""
    most = written(items.groupBy("seed_id").agg(F.max("depth").alias("depth")), "deepest")
    return items.join(most, ["seed_id", "depth"], "left_semi")


def at_level(items: DataFrame, level: int) -> DataFrame:
    return items.where(F.col("depth") == level)


def dedupe(items: DataFrame) -> DataFrame:
    """Of the children of a seed with one URL a Completed one stays if there is one, else the first in pre-order."""
    seeds = items.where("parent_id IS NULL")
    w = Window.partitionBy("seed_id", "url").orderBy((F.col("status") == "Completed").desc(), "path")
    kids = items.where("parent_id IS NOT NULL").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    # A seed's own URL doesn't repeat below it either, unless the child is what completed.
    return seeds.unionByName(kids)


def roots(deep: DataFrame) -> DataFrame:
    """(item_id, root) of items with path: the seed that an item hangs from."""
    return deep.select("item_id", F.substring_index("path", "/", 1).alias("root"))


def has_work() -> Column:
    return ~F.col("status").isin(*FINAL)


def complete(items: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """GotChildren and GotRedirected items without a child that has work become Completed, bottom up.

    Each round settles one more level and ends in a table (`keep`), until nothing changes.
    """
    n = 0
    while True:
        n += 1
        busy = items.where(has_work() & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("item_id")).distinct().withColumn("__busy", F.lit(True))
        waits = F.col("status").isin("GotChildren", "GotRedirected")
        marked = items.join(busy, "item_id", "left").withColumn("__done", waits & F.col("__busy").isNull())
        after = keep(marked.withColumn("status", F.when(F.col("__done"), "Completed").otherwise(F.col("status"))), f"complete{n}")
        changed = not after.where("__done").isEmpty()
        items = after.select(items.columns)
        if not changed:
            return items


def add_children(items: DataFrame, children: DataFrame, state: str) -> DataFrame:
    """Children join as Fresh; their parents take the state (GotChildren or GotRedirected)."""
    parents = children.select(F.col("parent_id").alias("item_id")).distinct().withColumn("__p", F.lit(True))
    marked = items.join(parents, "item_id", "left").withColumn("status", F.when(F.col("__p").isNotNull(), state).otherwise(F.col("status"))).drop("__p")
    return marked.select(items.columns).unionByName(children.withColumn("status", F.lit("Fresh")).select(items.columns))


def remove(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select("item_id"), "item_id", "left_anti")


def relations(items: DataFrame) -> DataFrame:
    """item_id, n_children, is_seed, is_child, is_redirection, has_redirection."""
    kids = items.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("item_id")).agg(F.count("*").alias("n_children"))
    parents = items.select(F.col("item_id").alias("parent_id"), F.col("status").alias("parent_status"))
    joined = items.join(kids, "item_id", "left").join(parents, "parent_id", "left")
    n = F.coalesce(F.col("n_children"), F.lit(0))
    return joined.select(
        "item_id", n.alias("n_children"), F.col("parent_id").isNull().alias("is_seed"), F.coalesce(F.col("parent_status") == "GotChildren", F.lit(False)).alias("is_child"),
        F.coalesce(F.col("parent_status") == "GotRedirected", F.lit(False)).alias("is_redirection"), ((n == 1) & (F.col("status") == "GotRedirected")).alias("has_redirection"),
    )


def violations(items: DataFrame) -> DataFrame:
    """(item_id, rule) of every broken invariant; must be empty."""
    parents = items.select(F.col("item_id").alias("parent_id"), F.col("status").alias("ps"))
    kids = items.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("item_id")).agg(F.count("*").alias("n"))
    all_ = items.join(parents, "parent_id", "left").join(kids, "item_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    child = F.col("parent_id").isNotNull()
    rules = {
        "no url": F.col("url").isNull() | (F.col("url") == ""),
        "no id": F.col("item_id").isNull() | (F.col("item_id") == ""),
        "unknown status": ~F.col("status").isin(*STATES),
        "unknown source": F.col("source").isNotNull() & ~F.col("source").isin(*SOURCES),
        "child with via": child & (F.coalesce("seed_via", F.lit("")) != ""),
        "fresh with children": (F.col("status") == "Fresh") & (F.col("n") > 0),
        "fresh child of a parent that has none": (F.col("status") == "Fresh") & child & ~F.coalesce(F.col("ps").isin("GotChildren", "GotRedirected"), F.lit(False)),
        "redirect with several children": (F.col("n") > 1) & (F.col("status") == "GotRedirected"),
        "children in a state without": (F.col("n") > 0) & ~F.col("status").isin("GotChildren", "GotRedirected", "Completed", "Failed"),
    }
    found = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull())
    return all_.select("item_id", F.explode(found).alias("rule"))


def css_jumps(items: DataFrame) -> DataFrame:
    """(item_id, jumps) of embedded style sheets: css items whose ancestors, redirects aside, are css items
    and then an html item; jumps counts the css ancestors. items need mime ('css', 'html' or other).

    Each round climbs one level and ends in a table; rounds end with the deepest chain of style sheets."""
    nodes = items.select("item_id", "parent_id", "mime", "status")
    up = nodes.where("mime = 'css' AND parent_id IS NOT NULL").select("item_id", F.col("parent_id").alias("at"), F.lit(0).alias("jumps"))
    found: list[DataFrame] = []
    while True:
        step = up.join(nodes.select(F.col("item_id").alias("at"), F.col("parent_id").alias("next"), F.col("mime").alias("m"), F.col("status").alias("s")), "at")
        step = written(step, "css")
        found.append(step.where("m = 'html' AND s <> 'GotRedirected'").select("item_id", "jumps"))
        up = step.where("next IS NOT NULL AND (s = 'GotRedirected' OR m = 'css')").select("item_id", F.col("next").alias("at"), (F.col("jumps") + F.when((F.col("m") == "css") & (F.col("s") != "GotRedirected"), 1).otherwise(0)).alias("jumps"))
        if up.isEmpty():
            return reduce(DataFrame.unionByName, found)


def draw(rows: list[tuple[str, str | None, str]]) -> str:
    """ASCII tree of one seed from collected (item_id, parent_id, label) rows, for debugging."""
    kids: dict[str | None, list[tuple[str, str]]] = {}
    for item, parent, label in rows:
        kids.setdefault(parent, []).append((item, label))
    out: list[str] = []
    stack = [(item, label, "", True, True) for item, label in reversed(kids.get(None, []))]
    while stack:
        item, label, indent, last, top = stack.pop()
        out.append(label if top else f"{indent}{'└── ' if last else '├── '}{label}")
        below = indent if top else indent + ("    " if last else "│   ")
        children = kids.get(item, [])
        stack.extend((i, x, below, n == len(children) - 1, False) for n, (i, x) in reversed(list(enumerate(children))))
    return "\n".join(out)
