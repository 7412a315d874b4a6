"""Expression graphs as tables: pruning, cycle breaking, merging of equal nodes and folding of constants.

Nodes are (graph, node, kind, params map<string,string>, defaults map<string,array<double>>) and edges are (graph,
from_node, from_socket, to_node, to_socket), many graphs to a table; names are unique within a graph, and a socket has one
edge into it. All passes work on all graphs at once by rounds of equal joins, as many as the deepest graph has levels; a
round's table is written to spark.checkpoint.dir, so a lost executor costs one round. Empty tables give empty tables,
edges whose ends do not exist do nothing, and null names link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import color, scalar, tables, vector
from lumenframe.operators.lineage import settled, shared_path

ROOT = "output"
AT = ["graph", "node"]
#: Steps of folding after which a graph is taken for one with a cycle; each but the last settles nodes.
ROUNDS = 10_000
#: Rounds that halve chains of nodes that are passed by: enough for any length.
CHAIN = 64
DEFAULTS = "map<string,array<double>>"
#: Most nodes of a level that are broadcast, so that the edges of all graphs stay where they are.
FEW = 100_000
RGB = ("r", "g", "b")
#: Kinds whose result is known as soon as their inputs are.
FOLDED = ("value", "color", "math", "invert", "gamma", "brightness_contrast", "rgb_to_bw", "mix", "separate_color", "combine_color", "rgb_curves", "vector_curves", "float_curve", "rgb_ramp", "separate_xyz", "combine_xyz", "clamp", "vector_math")


def _keep(d: DataFrame) -> DataFrame:
    return settled(d, "graph")


def reachable(nodes: DataFrame, edges: DataFrame, root: str = ROOT) -> DataFrame:
    """The nodes that the root of their graph needs, itself included."""
    needs = _keep(edges.select("graph", F.col("to_node").alias("node"), F.col("from_node").alias("next")).distinct())
    found = front = _keep(nodes.where(F.col("node") == root).select(*AT).distinct())
    while n := front.count():
        if n <= FEW:
            front = F.broadcast(front)
        front = _keep(needs.join(front, AT).select("graph", F.col("next").alias("node")).distinct().join(found, AT, "left_anti"))
        found = _keep(found.unionByName(front))
    return nodes.join(found, AT, "left_semi")


def break_cycles(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges without a cycle, edges taken out); only edges that lie on a cycle are taken out.

    Nodes that nothing leads to, or that lead nowhere, are on no cycle and are peeled off. Of what stays, each node learns
    the smallest node that leads to it; an edge from a node back to the one that it learned of closes a cycle. Such edges
    go, and so do, from the search but not from the result, the nodes whose own name is the smallest that they know: each
    round settles at least one node of each graph that still has a cycle.
    """
    names = edges.columns
    open_ = _keep(edges.select("graph", F.col("from_node").alias("a"), F.col("to_node").alias("b")).distinct())
    gone = None
    while True:
        while True:  # peel
            inner = open_.join(open_.select("graph", F.col("b").alias("a")).distinct(), ["graph", "a"], "left_semi").join(open_.select("graph", F.col("a").alias("b")).distinct(), ["graph", "b"], "left_semi")
            inner = _keep(inner.select("graph", "a", "b"))
            if inner.count() == open_.count():
                break
            open_ = inner
        if open_.isEmpty():
            break
        least = _keep(open_.select("graph", F.col("a").alias("node")).unionByName(open_.select("graph", F.col("b").alias("node"))).distinct().withColumn("low", F.col("node")))
        while True:
            near = open_.join(least.withColumnRenamed("node", "a"), ["graph", "a"]).groupBy("graph", F.col("b").alias("node")).agg(F.min("low").alias("near"))
            new = _keep(least.join(near, AT, "left").select("graph", "node", F.least("low", "near").alias("low"), (F.col("near") < F.col("low")).alias("moved")))
            least = new.drop("moved")
            if new.where("moved").isEmpty():
                break
        back = _keep(open_.join(least.withColumnRenamed("node", "a"), ["graph", "a"]).where(F.col("low") == F.col("b")).select("graph", "a", "b"))
        gone = back if gone is None else _keep(gone.unionByName(back))
        roots = least.where(F.col("node") == F.col("low")).select("graph", F.col("node").alias("a"))
        open_ = _keep(open_.join(back, ["graph", "a", "b"], "left_anti").join(roots, ["graph", "a"], "left_anti").select("graph", "a", "b"))
    if gone is None:
        return edges, edges.limit(0)
    taken = gone.distinct().select("graph", F.col("a").alias("from_node"), F.col("b").alias("to_node"))
    on = ["graph", "from_node", "to_node"]
    return edges.join(taken, on, "left_anti").select(*names), edges.join(taken, on, "left_semi").select(*names)


def _settings() -> Column:
    # one text for a node's own settings, independent of the order of its maps
    sort = lambda m: F.to_json(F.array_sort(F.map_entries(m)))
    return F.concat_ws("\x1f", "kind", sort(F.coalesce("params", F.create_map().cast("map<string,string>"))), sort(F.coalesce("defaults", F.create_map().cast("map<string,array<double>>"))))


def deduplicate(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, merged): equal nodes of a graph become the one with the smallest name; merged is (graph, node, into).

    Nodes are equal when kind, params, defaults of unlinked sockets and the sources of linked ones are. A round names
    each node by its settings and by its sources' names of the round before, so it sees one level deeper; rounds end when
    no name joins or parts any nodes. Nodes on cycles stay as they are; break cycles first. The root is never merged.
    """
    into = F.col("to_node").alias("node")
    linked = edges.groupBy("graph", into).agg(F.collect_set("to_socket").alias("linked"))
    own = nodes.join(linked, AT, "left").withColumn("linked", F.coalesce("linked", F.array().cast("array<string>")))
    own = own.withColumn("defaults", F.map_filter("defaults", lambda k, _: ~F.array_contains("linked", k)))
    own = own.select(*AT, F.when(F.col("node") == ROOT, F.lit("root")).otherwise(F.sha2(_settings(), 256)).alias("own"))
    named = _keep(own.withColumn("name", F.col("own")))
    kinds = named.select("graph", "name").distinct().count()
    while True:
        source = named.select("graph", F.col("node").alias("from_node"), F.col("name").alias("source"))
        fed = edges.join(source, ["graph", "from_node"]).groupBy("graph", into).agg(F.array_sort(F.collect_list(F.struct("to_socket", "source", "from_socket"))).alias("fed"))
        named = _keep(own.join(fed, AT, "left").select(*AT, "own", F.sha2(F.concat_ws("\x1f", "own", F.to_json("fed")), 256).alias("name")))
        now = named.select("graph", "name").distinct().count()
        if now == kinds:
            break
        kinds = now
    first = named.groupBy("graph", "name").agg(F.min("node").alias("into"))
    merged = _keep(named.join(first, ["graph", "name"]).where(F.col("node") != F.col("into")).select(*AT, "into"))
    left = edges.join(merged.select("graph", F.col("node").alias("to_node")), ["graph", "to_node"], "left_anti")
    moved = left.join(merged.select("graph", F.col("node").alias("from_node"), "into"), ["graph", "from_node"], "left").withColumn("from_node", F.coalesce("into", "from_node")).select(*edges.columns)
    return nodes.join(merged, AT, "left_anti"), moved, merged


def _results() -> str:
    """A map of output sockets, from columns a, b, c (numbers), colours and settings."""
    each = lambda v: f"array({', '.join(v)})"
    p, q = tuple(f"p_{k}" for k in RGB), tuple(f"q_{k}" for k in RGB)
    held = lambda x: f"(CASE WHEN params['use_clamp'] = 'true' THEN {scalar.clamp(x)} ELSE {x} END)"
    bend = lambda c: tables.curves(CURVE, tuple(f"{c}_{k}" for k in RGB), "bend", LOW, HIGH, DRAWN)
    slide = lambda t: tables.ramp(t, "bend", "coalesce(params['interpolate'], 'true') = 'true'")
    v, w, u = (tuple(f"{c}_{k}" for k in RGB) for c in "vwu")
    vectors = " ".join(f"WHEN '{op}' THEN map('vector', {each(vector.vector_math(op, v, w, u, 'length'))})" for op in vector.VECTORS)
    numbers = " ".join(f"WHEN '{op}' THEN map('value', array({f(v, w)}))" for op, f in vector.NUMBERS.items())
    sums = " ".join(f"WHEN '{op}' THEN {scalar.math(op, 'a', 'b', 'c')}" for op in (*scalar.UNARY, *scalar.BINARY, *scalar.TERNARY))
    mixes = " ".join(f"WHEN '{op}' THEN {each(color.mix(op, p, q, 'fac'))}" for op in color.CHANNEL)
    return f"""CASE kind
      WHEN 'value' THEN map('value', array(a))
      WHEN 'color' THEN map('color', {each(p)})
      WHEN 'math' THEN map('value', array({held(f"(CASE params['math_type'] {sums} END)")}))
      WHEN 'invert' THEN map('color', {each(color.invert(p, 'fac'))})
      WHEN 'gamma' THEN map('color', {each(color.gamma(p, 'a'))})
      WHEN 'brightness_contrast' THEN map('color', {each(color.bright_contrast(p, 'a', 'b'))})
      WHEN 'rgb_to_bw' THEN map('val', array({color.luminance(p)}))
      WHEN 'mix' THEN map('color', transform(CASE params['mix_type'] {mixes} END, x -> {held('x')}))
      WHEN 'separate_color' THEN map('r', array(p_r), 'g', array(p_g), 'b', array(p_b))
      WHEN 'combine_color' THEN map('color', array(a, b, c))
      WHEN 'rgb_curves' THEN map('color', {each(bend("p"))})
      WHEN 'vector_curves' THEN map('vector', {each(bend("v"))})
      WHEN 'float_curve' THEN map('value', {each(tables.curves(CURVE, ("a",), "bend", LOW, HIGH, DRAWN))})
      WHEN 'rgb_ramp' THEN map('color', {each(slide(tables.channel(RAMP, i)) for i in range(3))}, 'alpha', array({slide(ALPHA)}))
      WHEN 'separate_xyz' THEN map('x', array(v_r), 'y', array(v_g), 'z', array(v_b))
      WHEN 'combine_xyz' THEN map('vector', array(a, b, c))
      WHEN 'clamp' THEN map('result', array(CASE WHEN params['clamp_type'] = 'range' AND b > {TOP} THEN least(greatest(a, {TOP}), b) ELSE least(greatest(a, b), {TOP}) END))
      WHEN 'vector_math' THEN CASE params['math_type'] {vectors} {numbers} END END"""


#: The socket of each number and colour that a kind reads: fixed names of the graph format.
NUMBERS = {"a": ("value", "value1", "gamma", "bright", "r", "x"), "b": ("value2", "contrast", "g", "y", "min"), "c": ("value3", "b", "z"), "fac": ("fac",), "bend": ("fac",), "length": ("scale",)}
#: What a missing number counts as, where that is not 0.
MISSING = {"fac": 0.5, "length": 1.0}
COLOURS = {"p": ("color", "color1"), "q": ("color2",), "v": ("vector", "vector1"), "w": ("vector2",), "u": ("vector3",)}
#: The tables of curves and ramps, which are constants of their node, and the range of curves.
CURVE, RAMP = "coalesce(defaults['curves'], defaults['curve'])", "defaults['ramp']"
ALPHA = "transform(defaults['ramp_alpha'], x -> double(x))"
LOW, HIGH = "coalesce(defaults['min_x'][0], 0.0D)", "coalesce(defaults['max_x'][0], 1.0D)"
DRAWN = "coalesce(params['extrapolate'], 'true') = 'true'"
TOP = "coalesce(defaults['max'][0], 1.0D)"
#: A node of these kinds without its table is not known.
TABLED = {"rgb_curves": CURVE, "vector_curves": CURVE, "float_curve": CURVE, "rgb_ramp": f"CASE WHEN size({RAMP}) = 3 * size(defaults['ramp_alpha']) THEN {RAMP} END"}


def fold(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with every result that is known in the graph written into the sockets that it feeds.

    A node of FOLDED with no edge into it is known; its results become defaults of their sockets and its edges go, which
    may make the next nodes known. Between these steps, nodes whose result is one of their inputs are passed by (plus or
    minus 0, times or divided by 1, a mix by 0) and those that an input decides are set (times 0, to the power 0). Numbers
    are doubles; a missing default counts as 0, a missing factor as 0.5 (of curves and ramps as 0). Tables of curves lie in
    the defaults `curves` (three interleaved) or `curve`, those of ramps in `ramp` and `ramp_alpha`. Folded nodes stay, linked to nothing, until
    `reachable` prunes them. Break cycles first.

    Rounds work on open nodes alone: those of FOLDED that feed others, a row a node with its links. A node that has sent its
    result is open no longer, so tables shrink; sockets and edges of all nodes are written once, at the end.
    """
    nodes, edges = _keep(nodes), _keep(edges)
    links = edges.groupBy("graph", F.col("to_node").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct("to_socket", F.struct("from_node", "from_socket")))).alias("links"))
    used = edges.select("graph", F.col("from_node").alias("node")).distinct()
    open_ = nodes.where(F.col("kind").isin(*FOLDED)).select(*AT, "kind", "params", "defaults").join(used, AT, "left_semi").join(links, AT, "left")
    open_ = _keep(_acting(open_.withColumn("links", F.coalesce("links", F.create_map().cast(links.schema["links"].dataType)))))
    sent = shared_path(nodes.sparkSession, "sent")
    for step in range(ROUNDS):
        acts = {r["act"] for r in open_.where("act IS NOT NULL").select("act").distinct().collect()}
        if not acts:
            return _sent(nodes, edges, sent) if step else (nodes, edges)
        first = acts - {"known"} or acts
        now = _results_of(open_, first).withColumn("step", F.lit(step))
        now = (_resolved(_keep(now)) if "via" in acts else now).drop("step")
        now.write.parquet(f"{sent}/step={step}")
        now = nodes.sparkSession.read.schema(now.schema).parquet(f"{sent}/step={step}").hint("merge")
        open_ = _keep(_acting(_fed(open_.where(F.col("act").isNull() | ~F.col("act").isin(*first)), now)))
    raise RuntimeError(f"graphs still change after {ROUNDS} rounds: break cycles first")


def _results_of(open_: DataFrame, acts: set[str]) -> DataFrame:
    """(graph, from_node, via, number, results) of acting nodes: the socket that they pass on, or what they send from all sockets or from each."""
    acting = open_.where(F.col("act").isin(*acts))
    if acts != {"known"}:
        return acting.select("graph", F.col("node").alias("from_node"), F.when(F.col("act") == "via", F.col("via")).alias("via"), F.when(F.col("act") == "number", F.array("number")).alias("number"), F.lit(None).cast(DEFAULTS).alias("results"))
    number = lambda names, d: F.coalesce(*(F.col("defaults")[n][0] for n in names), F.lit(d))
    known = acting.select(*AT, "kind", "params", "defaults", "via", *(number(n, MISSING.get(k, 0.0)).alias(k) for k, n in NUMBERS.items()), *(F.coalesce(*(F.get(F.col("defaults")[x], F.lit(i)) for x in n), F.lit(0.0)).alias(f"{k}_{ch}") for k, n in COLOURS.items() for i, ch in enumerate(RGB)))
    return known.selectExpr("graph", "node AS from_node", "via", "CAST(NULL AS array<double>) AS number", f"{_results()} AS results")


def _resolved(now: DataFrame) -> DataFrame:
    """now with passed sockets of nodes that act in this round replaced by what these pass on or send; chains halve."""
    for _ in range(CHAIN):
        to = now.select("graph", F.col("from_node").alias("next"), F.col("via").alias("next_via"), F.col("number").alias("next_number"))
        met = now.withColumn("next", F.col("via.from_node")).join(to, ["graph", "next"], "left")
        hit = F.col("next_via").isNotNull() | F.col("next_number").isNotNull()
        met = _keep(met.select("graph", "from_node", F.when(hit, F.col("next_via")).otherwise(F.col("via")).alias("via"), F.coalesce("number", "next_number").alias("number"), "results", "step", hit.alias("hit")))
        now = met.drop("hit")
        if met.where("hit").isEmpty():
            return now
    raise RuntimeError(f"nodes still pass by each other after {CHAIN} rounds: break cycles first")


def _arrived() -> tuple[Column, Column]:
    # whether a result comes for an edge from a node that has acted, and the result
    own = F.coalesce(F.map_contains_key("results", F.col("from_socket")), F.lit(False))
    return F.col("number").isNotNull() | own, F.coalesce("number", F.col("results")[F.col("from_socket")])


def _fed(open_: DataFrame, now: DataFrame) -> DataFrame:
    """open_ with the results of now in its sockets and its links led past nodes that are passed by."""
    hit, result = _arrived()
    met = open_.select(*AT, F.explode("links").alias("to_socket", "link")).select(*AT, "to_socket", "link.*").join(now, ["graph", "from_node"])
    met = met.where(hit | F.col("via").isNotNull()).groupBy(*AT).agg(*(F.map_from_entries(F.collect_list(F.when(when, F.struct("to_socket", value.alias("value"))))).alias(name) for name, when, value in (("new", hit, result), ("moved", F.col("via").isNotNull(), F.col("via")))))
    without = lambda m, *others: F.map_filter(m, lambda k, _: ~_any(F.map_contains_key(o, k) for o in others))
    defaults = F.map_concat(without(F.coalesce("defaults", F.create_map().cast(DEFAULTS)), "new"), "new")
    links = F.map_concat(without("links", "new", "moved"), "moved")
    some = F.col("new").isNotNull()
    return open_.select(*AT, "kind", "params", "defaults", "links").join(met, AT, "left").select(*AT, "kind", "params", F.when(some, defaults).otherwise(F.col("defaults")).alias("defaults"), F.when(some, links).otherwise(F.col("links")).alias("links"))


def _any(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _sent(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after all that was sent in the tables of path, passed on from node to node."""
    spark, names = nodes.sparkSession, ["graph", "from_node", "from_socket", "to_node", "to_socket"]
    every = spark.read.parquet(path).drop("step").hint("merge")
    hit, result = _arrived()
    done, left = shared_path(spark, "ends"), edges.select(*names)
    for step in range(ROUNDS):
        met = left.join(every, ["graph", "from_node"], "left").select(*names, hit.alias("hit"), F.when(hit, result).alias("result"), F.when(~hit, F.col("via")).alias("via"))
        met.write.parquet(f"{done}/step={step}")
        met = spark.read.schema(met.schema).parquet(f"{done}/step={step}").hint("merge")
        left = met.where("via IS NOT NULL").select("graph", F.col("via.from_node").alias("from_node"), F.col("via.from_socket").alias("from_socket"), "to_node", "to_socket")
        if left.isEmpty():
            ends = spark.read.schema(met.schema).parquet(done).where("via IS NULL").hint("merge")
            return _write(nodes, ends.where("hit")), _keep(ends.where("NOT hit").select(*edges.columns))
    raise RuntimeError(f"edges still move after {ROUNDS} rounds: break cycles first")


def _write(nodes: DataFrame, sent: DataFrame) -> DataFrame:
    # sent: edges with a result; it becomes the default of the edge's socket
    new = sent.groupBy("graph", F.col("to_node").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct("to_socket", "result"))).alias("new"))
    old = F.map_filter(F.coalesce("defaults", F.create_map().cast(DEFAULTS)), lambda k, _: ~F.map_contains_key("new", k))
    return _keep(nodes.join(new, AT, "left").withColumn("defaults", F.when(F.col("new").isNull(), F.col("defaults")).otherwise(F.map_concat(old, "new"))).drop("new"))


def _acting(open_: DataFrame) -> DataFrame:
    """open_ with act, what a node can do now: send a number or pass on a linked socket (via) as its constant inputs decide, or send its results, which are known without links."""
    is_ = lambda socket, x: ~F.map_contains_key("links", F.lit(socket)) & (F.coalesce(F.col("defaults")[socket][0], F.lit(0.5 if socket == "fac" else 0.0)) == x)
    op = lambda *names: (F.col("kind") == "math") & F.col("params")["math_type"].isin(*names) & (F.coalesce(F.col("params")["use_clamp"], F.lit("false")) != "true")
    linked = lambda s: F.col("links")[s]
    via = F.when((op("add", "subtract") & is_("value2", 0.0)) | (op("multiply", "divide") & is_("value2", 1.0)), linked("value1"))
    via = via.when((op("add") & is_("value1", 0.0)) | (op("multiply") & is_("value1", 1.0)), linked("value2"))
    via = via.when((F.col("kind") == "mix") & is_("fac", 0.0) & (F.coalesce(F.col("params")["use_clamp"], F.lit("false")) != "true"), linked("color1"))
    for kind, socket in (("rgb_curves", "color"), ("vector_curves", "vector"), ("float_curve", "value")):
        none = ~F.map_contains_key("links", F.lit("fac")) & (F.coalesce(F.col("defaults")["fac"][0], F.lit(0.0)) == 0)
        via = via.when((F.col("kind") == kind) & none, linked(socket))
    result = F.when((op("multiply") & (is_("value1", 0.0) | is_("value2", 0.0))) | (op("divide") & is_("value1", 0.0)), F.lit(0.0)).when(op("power") & (is_("value2", 0.0) | is_("value1", 1.0)), F.lit(1.0))
    linked_, bare = F.size("links") > 0, " OR ".join(f"(kind = '{k}' AND coalesce(size({t}), 0) <= 0)" for k, t in TABLED.items())
    act = F.when(linked_ & F.col("number").isNotNull(), "number").when(linked_ & F.col("via").isNotNull(), "via").when(~linked_ & F.expr(f"NOT ({bare})"), "known")
    return open_.withColumns({"via": via, "number": result}).withColumn("act", act)


def finalise(nodes: DataFrame, edges: DataFrame, root: str = ROOT) -> tuple[DataFrame, DataFrame]:
    """Cycles broken, constants folded, equal nodes merged, and what the root does not need pruned."""
    whole, _ = break_cycles(edges)
    nodes, whole = fold(nodes, whole)
    nodes, whole, _ = deduplicate(nodes, whole)
    nodes = _keep(reachable(nodes, whole, root))
    ends = nodes.select("graph", F.col("node").alias("to_node"))
    return nodes, whole.join(ends, ["graph", "to_node"], "left_semi").select(*edges.columns)
