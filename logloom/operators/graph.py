"""The entity graph: typed nodes and edges, time-respecting reach, routes, shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.checkpoint import cut
from logloom.functions.regex import to_java
from logloom.sources.schema import severity_rank

# Edge kinds and whether they grant access, processes and paths that say nothing, limits, shape scores.
EDGE_KINDS = {"auth_failure": False, "auth_success": True, "escalated_to": True, "executed": True, "accessed": True, "connected_to": False, "created": True, "blocked": False, "referenced_canary": False}
QUIET_PROCESSES = ("sshd", "sudo", "CRON", "systemd")
PATH = r"(?<![\w:/])(/(?:[\w.@+-]+/)*[\w.@+-]+)"
BORING = ("/bin/bash", "/bin/sh", "/bin/cat", "/usr/bin/apt-get", "/usr/bin/apt", "/bin/systemctl", "/usr/bin/systemctl", "/usr/bin/journalctl", "/bin/ls", "/usr/bin/find", "/usr/bin/true", "/usr/bin/env", "/usr/bin/id")
MIN_PATH, MAX_PATHS, MAX_IDS, HOPS, FAN = 5, 5, 20, 3, 3
OUTCOME_EDGES = {"success": "auth_success", "failure": "auth_failure", "blocked": "blocked"}


def extract_paths(command: Column) -> Column:
    """The first few absolute paths of a command, distinct, without the common ones."""
    pattern = to_java(PATH).text.replace("(?d)", "(?dU)", 1)
    found = F.array_distinct(F.regexp_extract_all(command, F.lit(pattern), F.lit(1)))
    return F.slice(F.filter(found, lambda p: ~p.isin(*BORING) & (F.length(p) >= MIN_PATH)), 1, MAX_PATHS)


def _field(name: str) -> Column:
    return F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(""))


def _node(kind: Column | str, value: Column) -> Column:
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(k.alias("kind"), value.alias("label"))


def _parts(events: DataFrame) -> DataFrame:
    canary = F.filter(F.transform(F.split(_field("honeytoken"), ","), F.trim), lambda v: v != "")
    d = events.withColumns({"_target": _field("target_user"), "_files": extract_paths(_field("command")), "_canary": canary})
    return d.withColumn("_actor", F.when(F.col("_target") != "", F.col("_target")).otherwise(F.col("user")))


def _id(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), value)


def _canary_id(v: Column) -> Column:
    return F.concat(F.when(v.startswith("/"), "file:").otherwise("user:"), v)


def nodes(events: DataFrame) -> DataFrame:
    """``id, kind, label, events, peak_score, peak_severity, first_seen, last_seen, canary``; a user that is its own target counts twice."""
    d = _parts(events)
    runs = (F.col("_actor") != "") & (F.col("process") != "") & ~F.col("process").isin(*QUIET_PROCESSES)
    creator = (F.col("rule") == "new_user_created") & (F.col("user") != "")
    one = lambda kind, value, cond: F.when(cond, F.array(F.struct(F.lit(kind).alias("kind"), value.alias("label"), F.lit(False).alias("canary"))))
    each = [one(k, F.col(c), F.col(c) != "") for k, c in (("source_ip", "source_ip"), ("host", "host"), ("user", "user"), ("user", "_target"))]
    each += [one("process", F.col("process"), runs), one("user", F.when(F.col("_target") != "", F.col("_target")).otherwise("root"), creator)]
    each += [F.transform("_files", lambda p: F.struct(F.lit("file").alias("kind"), p.alias("label"), F.lit(False).alias("canary")))]
    each += [F.transform("_canary", lambda v: F.struct(F.when(v.startswith("/"), "file").otherwise("user").alias("kind"), v.alias("label"), F.lit(True).alias("canary")))]
    none = F.array().cast("array<struct<kind:string,label:string,canary:boolean>>")
    x = d.select("timestamp", "score", "severity", F.explode(F.concat(*[F.coalesce(e, none) for e in each])).alias("n")).select("timestamp", "score", "severity", "n.*")
    names = F.array(*[F.lit(s) for s in ("info", "notice", "warning", "high", "critical")])
    g = x.groupBy("kind", "label").agg(F.count("*").alias("events"), F.greatest(F.max("score"), F.lit(0)).alias("peak_score"), F.element_at(names, F.max(severity_rank(F.col("severity"))) + 1).alias("peak_severity"),
                                       F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.max("canary").alias("canary"))
    return g.select(F.concat_ws(":", "kind", "label").alias("id"), "*")


def edge_rows(events: DataFrame, keep: tuple[str, ...] = ("seq", "timestamp", "score", "raw_sha256")) -> DataFrame:
    """One row for each interaction of an event: ``src, dst, kind`` and the event's columns to keep."""
    d = _parts(events)
    s, u, t, a = F.col("source_ip"), F.col("user"), F.col("_target"), F.col("_actor")
    edge = lambda cond, src, dst, kind: F.when(cond, F.array(F.struct(src.alias("src"), dst.alias("dst"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))))
    outcome = F.element_at(F.create_map(*[F.lit(x) for kv in OUTCOME_EDGES.items() for x in kv]), F.when(F.col("outcome").isin(*OUTCOME_EDGES), F.col("outcome")))
    each = [
        edge((s != "") & (u != "") & outcome.isNotNull(), _id("source_ip", s), _id("user", u), outcome),
        edge((s != "") & (u == "") & (F.col("host") != ""), _id("source_ip", s), _id("host", F.col("host")), "connected_to"),
        edge((u != "") & (t != "") & (u != t), _id("user", u), _id("user", t), "escalated_to"),
        edge((a != "") & (F.col("process") != "") & ~F.col("process").isin(*QUIET_PROCESSES), _id("user", a), _id("process", F.col("process")), "executed"),
        F.when(a != "", F.transform("_files", lambda p: F.struct(_id("user", a).alias("src"), _id("file", p).alias("dst"), F.lit("accessed").alias("kind")))),
        edge((F.col("rule") == "new_user_created") & (u != ""), _id("user", F.when(t != "", t).otherwise("root")), _id("user", u), "created"),
        F.when((s != "") | (u != ""), F.transform("_canary", lambda v: F.struct(F.when(s != "", _id("source_ip", s)).otherwise(_id("user", u)).alias("src"), _canary_id(v).alias("dst"), F.lit("referenced_canary").alias("kind")))),
    ]
    none = F.array().cast("array<struct<src:string,dst:string,kind:string>>")
    x = d.select(*keep, F.explode(F.concat(*[F.coalesce(e, none) for e in each])).alias("e"))
    return x.select(*keep, "e.*").where("src <> dst")


def grants(kind: str = "kind") -> Column:
    return F.col(kind).isin(*[k for k, v in EDGE_KINDS.items() if v])


def edges(events: DataFrame) -> DataFrame:
    """``src, dst, kind, count, peak_score, grants_access, first_seen, last_seen``."""
    g = edge_rows(events, ("timestamp", "score")).groupBy("src", "dst", "kind").agg(F.count("*").alias("count"), F.greatest(F.max("score"), F.lit(0)).alias("peak_score"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    return g.withColumn("grants_access", grants())


def edge_events(events: DataFrame, n: int = MAX_IDS) -> DataFrame:
    """``src, dst, kind, event_ids``: the newest ``n`` fingerprints of each edge, ranked before they are gathered."""
    w = W.partitionBy("src", "dst", "kind").orderBy(F.col("seq").desc())
    top = edge_rows(events).where("raw_sha256 <> ''").withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    return top.groupBy("src", "dst", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "raw_sha256"))), lambda x: x["raw_sha256"]).alias("event_ids"))


def blast_radius(node: DataFrame, edge: DataFrame, seed: str, max_hops: int = HOPS, access_only: bool = True, respect_time: bool = True) -> DataFrame:
    """``id, hops, arrival`` of all that is reachable from ``seed``.

    An edge is crossed only if it was last used at or after the arrival at its source. A node
    is expanded again whenever its hop or its arrival improves, and keeps the least of both.
    A round is one join of the improved nodes with the edges and one combined minimum. The
    edges are written once: rounds don't read the events again.
    """
    e = edge.where("grants_access") if access_only else edge
    e = cut(e.select("src", "dst", F.col("first_seen").alias("ef"), F.col("last_seen").alias("el")))
    known = cut(node.where(F.col("id") == seed).select("id", F.lit(0).alias("hops"), F.col("first_seen").alias("arrival")))
    front = known
    while not front.isEmpty():
        j = front.where(F.col("hops") < max_hops).join(e, front["id"] == e["src"])
        timed = F.lit(respect_time) & F.col("arrival").isNotNull() & F.col("el").isNotNull()
        j = j.where(~timed | (F.col("el") >= F.col("arrival")))
        there = F.when(timed, F.greatest("ef", "arrival")).otherwise(F.coalesce("ef", "arrival"))
        step = j.select(F.col("dst").alias("id"), (F.col("hops") + 1).alias("h"), there.alias("t")).groupBy("id").agg(F.min("h").alias("h"), F.min("t").alias("t"))
        better = step.join(known.withColumnsRenamed({"hops": "kh", "arrival": "kt"}), "id", "left").where("kh IS NULL OR h < kh OR t < kt")
        front = cut(better.select("id", F.least("h", "kh").alias("hops"), F.least("t", "kt").alias("arrival")))
        known = cut(known.join(front.select("id"), "id", "left_anti").unionByName(front))
    return known


def radius_by_kind(radius: DataFrame) -> DataFrame:
    return radius.where("hops > 0").groupBy(F.substring_index("id", ":", 1).alias("kind")).agg(F.count("*").alias("n"))


def components(node: DataFrame, edge: DataFrame) -> DataFrame:
    """``id, component``: the least id of each weakly connected part, by minimum labels with pointer jumping."""
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = cut(edge.select(F.inline(F.array(pair("src", "dst"), pair("dst", "src")))).distinct())
    label = cut(node.select("id", F.col("id").alias("c")))
    while True:
        seen = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("c").alias("m"))
        hooked = label.join(seen, label["id"] == seen["a"], "left").select("id", "c", F.least("c", "m").alias("m"))
        # a root takes the least label that any node of its tree sees
        root = cut(hooked.where("m < c").groupBy("c").agg(F.min("m").alias("m")).withColumnRenamed("c", "r"))
        if root.isEmpty():
            return label.withColumnRenamed("c", "component")
        label = cut(label.join(root, label["c"] == root["r"], "left").select("id", F.coalesce("m", "c").alias("c")))
        up = label.select(F.col("id").alias("p"), F.col("c").alias("pc"))
        label = cut(label.join(up, label["c"] == up["p"], "left").select("id", F.coalesce("pc", "c").alias("c")))


def routes(edge: DataFrame, starts: DataFrame, access_only: bool = True) -> DataFrame:
    """``start, id, path``: a shortest route from every start to all it reaches; of equals the first by name.

    Frontiers carry paths, one for each (start, node), and stop when nothing new is reached.
    """
    e = (edge.where("grants_access") if access_only else edge).select("src", "dst")
    if not access_only:
        e = e.union(edge.select("dst", "src"))
    e = cut(e.distinct())
    front = cut(starts.select(F.col("id").alias("start"), "id", F.array("id").alias("path")).distinct())
    done = front
    while True:
        step = front.join(e, front["id"] == e["src"]).select("start", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        front = cut(step.join(done.select("start", "id"), ["start", "id"], "left_anti").groupBy("start", "id").agg(F.min("path").alias("path")))
        if front.isEmpty():
            return done
        done = cut(done.unionByName(front))


def shortest_path(edge: DataFrame, src: str, dst: str, access_only: bool = True) -> list[str]:
    start = edge.sparkSession.createDataFrame([(src,)], "id string")
    row = routes(edge, start, access_only).where(F.col("id") == dst).first()
    return list(row.path) if row else []


def _shape(name: str, centre: str, members: Column, severity: Column, score: Column) -> list[Column]:
    return [F.lit(name).alias("name"), F.col(centre).alias("centre"), F.array_sort(members).alias("members"), severity.alias("severity"), score.cast("int").alias("score")]


def stars(edge: DataFrame, fan: int = FAN) -> DataFrame:
    """One source that touches many accounts."""
    e = edge.where(F.col("src").startswith("source_ip:"))
    g = e.groupBy("src").agg(F.collect_set(F.when(F.col("dst").startswith("user:"), F.col("dst"))).alias("m"), F.max(F.when(F.col("kind") == "auth_success", 1).otherwise(0)).alias("won"))
    n = F.size("m")
    return g.where(n >= fan).select(*_shape("star", "src", F.col("m"), F.when(F.col("won") == 1, "critical").otherwise("high"), 70 + F.least(n, F.lit(20)) + 25 * F.col("won")))


def funnels(edge: DataFrame, fan: int = FAN) -> DataFrame:
    """Many sources on one account."""
    e = edge.where(F.col("dst").startswith("user:") & F.col("src").startswith("source_ip:"))
    g = e.groupBy("dst").agg(F.collect_set("src").alias("m"))
    return g.where(F.size("m") >= fan).select(*_shape("funnel", "dst", F.col("m"), F.lit("high"), 65 + F.least(F.size("m"), F.lit(25))))


def bridges(edge: DataFrame) -> DataFrame:
    """An account reached from two sources or more."""
    e = edge.where(F.col("dst").startswith("user:") & F.col("src").startswith("source_ip:") & F.col("grants_access"))
    g = e.groupBy("dst").agg(F.collect_set("src").alias("m"))
    return g.where(F.size("m") >= 2).select(*_shape("bridge", "dst", F.col("m"), F.lit("critical"), F.lit(85)))


def chains(node: DataFrame, edge: DataFrame, least: int = 3) -> DataFrame:
    """Of each source the longest of its shortest routes to a file or process."""
    node = cut(node.select("id", "kind", "peak_score"))
    starts = node.where(F.col("kind") == "source_ip").select("id")
    r = routes(edge, starts).where(F.col("id").startswith("file:") | F.col("id").startswith("process:"))
    best = cut(r.groupBy("start").agg(F.max_by("path", F.struct(F.size("path"), F.col("path"))).alias("path")).where(F.size("path") >= least))
    peak = best.select("start", F.explode("path").alias("id")).join(node.select("id", "peak_score"), "id").groupBy("start").agg(F.max("peak_score").alias("peak"))
    d = best.join(peak, "start")
    return d.select(F.lit("chain").alias("name"), F.col("start").alias("centre"), F.col("path").alias("members"), F.when(F.col("peak") >= 80, "critical").otherwise("high").alias("severity"), (75 + 3 * F.size("path")).cast("int").alias("score"))


def shapes(node: DataFrame, edge: DataFrame, fan: int = FAN) -> DataFrame:
    edge = cut(edge)
    return reduce(DataFrame.unionByName, [stars(edge, fan), funnels(edge, fan), chains(node, edge), bridges(edge)]).orderBy(F.col("score").desc(), "name", "centre")


def busiest(node: DataFrame, n: int = 5) -> DataFrame:
    return node.orderBy(F.col("events").desc(), "id").limit(n)


def to_dot(node: DataFrame, edge: DataFrame) -> list[str]:
    """Graphviz text of a graph that is small enough to be drawn."""
    q = lambda c: F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    shape = F.element_at(F.create_map(*[F.lit(x) for x in ("source_ip", "ellipse", "user", "box", "file", "note", "process", "component", "host", "house")]), F.col("kind"))
    a = node.select(F.format_string('  "%s" [label="%s", shape=%s, tooltip="%s, peak %s"];', q("id"), q("label"), shape, "kind", "peak_severity").alias("line"))
    b = edge.select(F.format_string('  "%s" -> "%s" [label="%s ×%d", style=%s];', q("src"), q("dst"), "kind", "count", F.when(F.col("grants_access"), "solid").otherwise("dashed")).alias("line"))
    return ["digraph events {", "  rankdir=LR;", '  node [shape=box, fontname="sans"];', *[r.line for r in a.orderBy("line").toLocalIterator()], *[r.line for r in b.orderBy("line").toLocalIterator()], "}"]
