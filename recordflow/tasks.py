"""Tasks with blockers and parents: membership tests, trees, counts and due dates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import free_name
from .operators import numbered
from .session import shared_dir


def edges(tasks: DataFrame) -> DataFrame:
    """(id, blocker) for every entry of blockers."""
    return tasks.select("id", F.explode("blockers").alias("blocker"))


def _open_edges(tasks: DataFrame) -> DataFrame:
    pending = tasks.where("status = 'pending'").select(F.col("id").alias("blocker"))
    return edges(tasks).join(pending, "blocker", "left_semi").select("id").distinct()


def blocked(tasks: DataFrame) -> DataFrame:
    """Pending tasks with a blocker that is pending, too."""
    return tasks.where("status = 'pending'").join(_open_edges(tasks), "id", "left_semi")


def ready(tasks: DataFrame) -> DataFrame:
    """Pending tasks without one."""
    return tasks.where("status = 'pending'").join(_open_edges(tasks), "id", "left_anti")


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a table in the shared folder, so that what follows does not depend on the executors before."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def reach(edges: DataFrame, sources: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, id, depth) of all that can be reached over edges (child, up) from ids, level by level.

    For graphs in which a child has several parents.  An id is listed once for each root, where
    it is met first; a level without a new (root, id) ends the search, so cycles end too.
    """
    spark = edges.sparkSession
    folder, paths = f"{shared_dir(spark)}/recordflow-tree-{uuid.uuid4().hex}", []
    level = sources.select(F.col("id").alias("root"), "id").distinct()
    schema = level.withColumn("depth", F.lit(0)).schema
    while True:
        d = len(paths)
        level = _written(level.select("root", "id", F.lit(d).alias("depth")), folder, str(d))
        paths.append(f"{folder}/{d}")
        out = spark.read.schema(schema).parquet(*paths)
        if d == depth or level.isEmpty():
            return out
        below = level.join(edges, level.id == edges.up).select("root", F.col("child").cast(schema["id"].dataType).alias("id")).distinct()
        level = below.join(out.select("root", "id"), ["root", "id"], "left_anti")


def _nearest(links: DataFrame, roots: DataFrame, folder: str) -> DataFrame:
    """(id, at, dist): of each id below a root the nearest one and how far it is.

    Pointers to parents are doubled: one that has not come to a root goes on from where it points to, by that
    one's own pointer.  A round without fewer open pointers ends it: what is left goes round in a cycle without a root.
    """
    spark = links.sparkSession
    ends = roots.select(F.col("id").alias("at"), F.lit(True).alias("done"))
    now = links.select(F.col("child").alias("id"), F.col("up").alias("at"), F.lit(1).alias("dist")).join(ends, "at", "left").select("id", "at", "dist", F.coalesce("done", F.lit(False)).alias("done"))
    now = _written(now, folder, "0")
    number, left = 0, now.where("not done").count()
    while left:
        a, b = now.where("not done").alias("a"), now.alias("b")
        moved = a.join(b, F.col("a.at") == F.col("b.id")).select("a.id", "b.at", (F.col("a.dist") + F.col("b.dist")).alias("dist"), "b.done")
        number += 1
        now = _written(now.where("done").unionByName(moved), folder, str(number))
        _removed(spark, f"{folder}/{number - 1}")
        before, left = left, now.where("not done").count()
        if left == before:
            break
    return now.where("done").select("id", "at", "dist")


def tree(tasks: DataFrame, roots: DataFrame, parent: str = "parent", depth: int | None = None) -> DataFrame:
    """(root, id, depth) of everything below the roots, to any depth unless one is given.

    An id is listed once for each root above it, at its least depth; a root is below itself at 0.  Cycles end.
    The number of rounds is the binary logarithm of the depth, and not the depth: pointers to the
    nearest root above are doubled, then those from root to root.  Where an id has several parents, reach() is used.
    """
    spark = tasks.sparkSession
    kind = tasks.schema["id"].dataType
    links = tasks.select(F.col("id").alias("child"), F.col(parent).cast(kind).alias("up")).where("up is not null and child is not null").distinct()
    if not links.groupBy("child").count().where("count > 1").isEmpty():
        return reach(links, roots, depth)
    folder = f"{shared_dir(spark)}/recordflow-tree-{uuid.uuid4().hex}"
    roots = roots.select(F.col("id").cast(kind).alias("id")).where("id is not null").distinct()
    near = _nearest(links, roots, folder)
    least = lambda df: df.groupBy("root", "id").agg(F.min("depth").alias("depth"))
    over = near.join(roots, "id", "left_semi").select(F.col("at").alias("root"), "id", F.col("dist").alias("depth"))
    over, number, size = _written(least(over), folder, "over0"), 0, -1
    while size != (now := over.count()):  # from root to root: as far again as before in each round
        size, number = now, number + 1
        a, b = over.alias("a"), over.alias("b")
        further = a.join(b, F.col("a.root") == F.col("b.id")).select("b.root", "a.id", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        over = _written(least(over.unionByName(further)), folder, f"over{number}")
        _removed(spark, f"{folder}/over{number - 1}")
    n, o = near.alias("n"), over.alias("o")
    first = near.select(F.col("at").alias("root"), "id", F.col("dist").alias("depth"))
    above = n.join(o, F.col("n.at") == F.col("o.id")).select("o.root", "n.id", (F.col("n.dist") + F.col("o.depth")).alias("depth"))
    own = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"))
    out = least(first.unionByName(above).unionByName(own))
    return out if depth is None else out.where(F.col("depth") <= depth)


def _weighed(tasks: DataFrame, today: str, horizon: int) -> DataFrame:
    """A row of counts: by status, and of pending tasks by priority, blockers and due date."""
    blocked_ids = _open_edges(tasks).select(F.col("id").alias("_blocked"))
    rows = tasks.join(blocked_ids, F.col("id") == F.col("_blocked"), "left")
    pending, held = F.col("status") == "pending", F.col("_blocked").isNotNull()
    days = F.date_diff(F.to_date("due"), F.lit(today).cast("date"))
    tests = {s: F.col("status") == s for s in ("pending", "done", "skipped")}
    tests |= {p: pending & (F.col("priority") == p) for p in ("high", "med", "low")}
    tests |= {"ready": pending & ~held, "blocked": pending & held}
    tests |= {"overdue": pending & (days < 0), "soon": pending & days.between(0, horizon), "none": pending & F.col("due").isNull()}
    return rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(t).alias(k) for k, t in tests.items()))


def counts(tasks: DataFrame, today: str) -> DataFrame:
    """total, pending, done, skipped, ready, blocked and overdue, in one row."""
    return _weighed(tasks, today, 7).select("total", "pending", "done", "skipped", "ready", "blocked", "overdue")


def stats(tasks: DataFrame, today: str, horizon: int = 7, n: int = 5) -> DataFrame:
    """The dashboard in one row: counts by status, and of pending tasks by priority, workflow and due date, and their n most frequent tags."""
    tags = top_tags(tasks.where("status = 'pending'"), n, F.desc("tag")).agg(F.sort_array(F.collect_list(F.struct("count", "tag")), asc=False).alias("t"))
    tags = tags.select(F.transform("t", lambda e: F.struct(e["tag"].alias("tag"), e["count"].alias("count"))).alias("top_tags"))
    groups = {"priority": ("high", "med", "low"), "workflow": ("ready", "blocked"), "due": ("overdue", "soon", "none")}
    row = _weighed(tasks, today, horizon).select("total", "pending", "done", "skipped", *(F.struct(*names).alias(k) for k, names in groups.items()))
    both = row.unionByName(tags, allowMissingColumns=True)  # two rows, put together
    return both.agg(*(F.first(c, ignorenulls=True).alias(c) for c in both.columns))


def export_rows(tasks: DataFrame) -> DataFrame:
    """id, text, status, priority, due, tags, blockers, notes_count and parent as a CSV holds them: lists joined by semicolons."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c)
    return tasks.select("id", "text", "status", "priority", "due", joined("tags"), joined("blockers"), F.size("notes").alias("notes_count"), "parent")


#: Marks of the Markdown list, as the format has them.
SECTIONS = (("pending", "Pending", "- [ ] "), ("done", "Done", "- [x] "), ("skipped", "Skipped", "- [~] "))
PRIORITY_MARKS = {"high": " 🔴", "low": " 🟢"}


def export_markdown(tasks: DataFrame, order: list[str]) -> DataFrame:
    """part, place and line of a Markdown list: a heading and the tasks of each status, tasks by order; sort by part and place."""
    spark = tasks.sparkSession
    marks = F.lit("")
    for name, mark in PRIORITY_MARKS.items():
        marks = F.when(F.col("priority") == name, mark).otherwise(marks)
    due_mark = F.when(F.col("due").isNotNull(), F.concat(F.lit(" (due: "), F.col("due").cast("string"), F.lit(")"))).otherwise("")
    out = spark.createDataFrame([(0, 0, "# Todo List"), *((2 * k + 1, 0, f"## {title}") for k, (_, title, _) in enumerate(SECTIONS))], "part int, place bigint, line string")
    for k, (status, _, box) in enumerate(SECTIONS):
        own = numbered(tasks.where(F.col("status") == status), order, place := free_name("place", tasks.columns))
        text = F.concat(F.lit(box), F.coalesce("text", F.lit("")), *([marks, due_mark] if status == "pending" else []))
        out = out.unionAll(own.select(F.lit(2 * k + 2).alias("part"), F.col(place), text))
    return out


def top_tags(tasks: DataFrame, n: int = 5, ties: Column | str = "tag") -> DataFrame:
    """The n most frequent tags; equally frequent ones by the second order."""
    return tasks.select(F.explode("tags").alias("tag")).groupBy("tag").count().orderBy(F.desc("count"), ties).limit(n)


def search(tasks: DataFrame, text: str) -> DataFrame:
    """Tasks whose text holds a string, in either case."""
    return tasks.where(F.lower("text").contains(text.lower()))


def due(tasks: DataFrame, today: str, horizon: int = 7) -> DataFrame:
    """Pending tasks with bucket: overdue, soon (within the horizon) or upcoming; tasks without a date are left out."""
    days = F.date_diff(F.to_date("due"), F.lit(today).cast("date"))
    return tasks.where("due is not null and status = 'pending'").withColumn("bucket", F.when(days < 0, "overdue").when(days <= horizon, "soon").otherwise("upcoming"))


def rename_tag(tasks: DataFrame, old: str, new: str) -> DataFrame:
    return tasks.withColumn("tags", F.array_distinct(F.transform("tags", lambda t: F.when(t == old, new).otherwise(t))))


def resolve(tasks: DataFrame, prefix: str) -> DataFrame:
    """Tasks whose id starts with a prefix."""
    return tasks.where(F.col("id").cast("string").startswith(prefix))
