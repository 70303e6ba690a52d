"""Field graphs: normalize, edit, validate, and compile to one Column expression.

A graph is a dict of id, name, nodes (id, type, label, position, params) and edges (id, from, to; each
end a nodeId and a portId). Graphs are small documents, so they are checked on the driver; fields are
evaluated by Catalyst. validate_table does the check for many graphs at once as joins.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import noise
from ..functions import scalars as S
from .registry import FLOAT, NODES, VEC2, port, port_table

# The messages of validation.
ONE_OUTPUT = "A noise graph must have exactly one output node."
MISSING = "Edge references a missing node or port."
DIRECTION = "Edges must connect output ports to input ports."
ONE_EDGE = "An input port can only have one incoming edge."


def _number(value, fallback: float) -> float:
    """A finite number read leniently from JSON: text counts, also the empty one as 0; else the fallback."""
    if value is None:
        return fallback
    if isinstance(value, str):
        value = value.strip() or "0"
    try:
        out = float(value)
    except (TypeError, ValueError):
        return fallback
    return out if math.isfinite(out) else fallback


def create_node(node_type: str, position: dict | None = None, node_id: str | None = None, params: dict | None = None) -> dict:
    label, _, _, _, defaults = NODES[node_type]
    return {"id": node_id or str(uuid.uuid4()), "type": node_type, "label": label, "position": position or {"x": 120, "y": 120}, "params": defaults | (params or {})}


def create_graph(graph_id: str, name: str) -> dict:
    nodes = [create_node("cartesianPosition", {"x": 60, "y": 120}), create_node("output", {"x": 620, "y": 140})]
    return {"version": 1, "id": graph_id, "name": name, "nodes": nodes, "edges": []}


def resolve(graph: dict, end: dict) -> tuple[str, str] | None:
    """(direction, value type) of the port that an edge's end names, or None."""
    kind = next((n["type"] for n in graph["nodes"] if n["id"] == end["nodeId"]), None)
    return port(kind, end["portId"]) if kind else None


def normalize(value, fallback_id: str | None = None, fallback_name: str = "Field") -> dict:
    """A well-formed graph from any JSON value: unknown nodes and dangling edges go, reversed edges are turned, an output is added."""
    fallback_id = fallback_id or str(uuid.uuid4())
    if not isinstance(value, dict):
        return create_graph(fallback_id, fallback_name)

    def text(x) -> str | None:
        return x if isinstance(x, str) and x else None

    nodes = []
    for n in value.get("nodes") if isinstance(value.get("nodes"), list) else []:
        if isinstance(n, dict) and isinstance(n.get("type"), str) and n["type"] in NODES:
            place = n["position"] if isinstance(n.get("position"), dict) else {}
            made = create_node(n["type"], {k: _number(place.get(k), 120) for k in "xy"}, text(n.get("id")), n["params"] if isinstance(n.get("params"), dict) else None)
            nodes.append(made | ({"label": n["label"]} if isinstance(n.get("label"), str) else {}))
    if not any(n["type"] == "output" for n in nodes):
        nodes.append(create_node("output", {"x": 620, "y": 140}))
    name = value.get("name")
    graph = {"version": 1, "id": text(value.get("id")) or fallback_id, "name": name if isinstance(name, str) and name.strip() else fallback_name, "nodes": nodes, "edges": []}
    if isinstance(value.get("description"), str):
        graph["description"] = value["description"]
    for e in value.get("edges") if isinstance(value.get("edges"), list) else []:
        ends = [e.get(k) for k in ("from", "to")] if isinstance(e, dict) else [None]
        if not all(isinstance(x, dict) and isinstance(x.get("nodeId"), str) and isinstance(x.get("portId"), str) for x in ends):
            continue
        a, b = ({"nodeId": x["nodeId"], "portId": x["portId"]} for x in ends)
        known = resolve(graph, a), resolve(graph, b)
        if None in known:
            continue
        if known[0][0] == "input" and known[1][0] == "output":
            a, b = b, a
        graph["edges"].append({"id": text(e.get("id")) or str(uuid.uuid4()), "from": a, "to": b})
    return graph


def validate(graph: dict) -> list[dict]:
    """The graph's errors in the order of its edges; an empty list is a valid graph."""
    issues = [] if sum(n["type"] == "output" for n in graph["nodes"]) == 1 else [{"message": ONE_OUTPUT, "edgeId": None}]
    taken = set()
    for e in graph["edges"]:
        a, b = resolve(graph, e["from"]), resolve(graph, e["to"])
        if a is None or b is None:
            issues.append({"message": MISSING, "edgeId": e["id"]})
            continue
        target = (e["to"]["nodeId"], e["to"]["portId"])
        checks = [((a[0], b[0]) != ("output", "input"), DIRECTION), (a[1] != b[1], f"Cannot connect {a[1]} to {b[1]}."), (target in taken, ONE_EDGE)]
        issues += [{"message": m, "edgeId": e["id"]} for bad, m in checks if bad]
        taken.add(target)
    return issues


def can_connect(graph: dict, a: dict, b: dict) -> bool:
    """Ports of two nodes, of opposite direction and equal value type."""
    first, second = resolve(graph, a), resolve(graph, b)
    return a["nodeId"] != b["nodeId"] and None not in (first, second) and first[0] != second[0] and first[1] == second[1]


def connect(graph: dict, a: dict, b: dict) -> dict | None:
    """The graph with an edge between two ports, in place of any other into the same input; None if they do not fit."""
    if not can_connect(graph, a, b):
        return None
    start, end = (a, b) if resolve(graph, a)[0] == "output" else (b, a)
    return graph | {"edges": [e for e in graph["edges"] if e["to"] != end] + [{"id": str(uuid.uuid4()), "from": start, "to": end}]}


def delete(graph: dict, node_id: str | None = None, edge_id: str | None = None) -> dict:
    """The graph without an edge, or without a node and the edges that touch it; the output node stays."""
    if edge_id:
        return graph | {"edges": [e for e in graph["edges"] if e["id"] != edge_id]}
    if not any(n["id"] == node_id and n["type"] != "output" for n in graph["nodes"]):
        return graph
    return graph | {"nodes": [n for n in graph["nodes"] if n["id"] != node_id], "edges": [e for e in graph["edges"] if node_id not in (e["from"]["nodeId"], e["to"]["nodeId"])]}


def seed_slots(graphs: list[dict]) -> dict[int, int]:
    """Every seed that the graphs' noise nodes draw from, one per octave, numbered from 0 in ascending order."""
    seeds = set()
    for node in (n for g in graphs for n in g["nodes"] if n["type"] in ("simplex2d", "fbm2d", "ridged2d")):
        octaves = 1 if node["type"] == "simplex2d" else min(12, max(1, math.trunc(_number(node["params"].get("octaves"), 5))))
        seeds |= {math.trunc(_number(node["params"].get("seed"), 1)) + noise.OCTAVE_SEED * i for i in range(octaves)}
    return {seed: slot for slot, seed in enumerate(sorted(seeds))}


def search_nodes(query: str) -> list[str]:
    """Node types whose label, category or type holds the text, letters' case aside; the output node is not offered."""
    return [t for t, n in NODES.items() if t != "output" and query.strip().lower() in f"{n[0]} {n[1]} {t}".lower()]


def compile_graph(graph: dict | None, x: Column, y: Column) -> Column | None:
    """The field's value at world position (x, y); None for a missing or invalid graph and for a cycle that the output reaches.

    Nodes that the output does not reach are never emitted. A node used twice is the same expression
    object twice, which Catalyst evaluates once; noise nodes send their points to Python in one call each.
    """
    if graph is None or validate(graph):
        return None
    nodes = {n["id"]: n for n in graph["nodes"]}
    into = {(e["to"]["nodeId"], e["to"]["portId"]): e["from"] for e in graph["edges"]}
    made: dict[str, Column] = {}
    open_: set[str] = set()

    def param(node: dict, key: str, fallback: float) -> float:
        return _number(node["params"].get(key), fallback)

    def floating(node: dict, name: str, fallback) -> Column:
        end = into.get((node["id"], name))
        if end is None or resolve(graph, end)[1] != FLOAT:
            return S.num(fallback)
        return emit(nodes[end["nodeId"]], end["portId"])

    def place(node: dict) -> tuple[Column, Column]:
        end = into.get((node["id"], "xy"))
        if end is not None and resolve(graph, end)[1] == VEC2:
            return x, y
        return floating(node, "x", x), floating(node, "y", y)

    def emit(node: dict, name: str) -> Column:
        if node["type"] == "cartesianPosition":
            return x if name == "x" else y
        if node["id"] not in made:
            if node["id"] in open_:
                raise RecursionError(node["id"])
            open_.add(node["id"])
            made[node["id"]] = NODE_COLUMNS[node["type"]](node, floating, place, param)
        return made[node["id"]]

    try:
        return floating(next(n for n in graph["nodes"] if n["type"] == "output"), "value", 1)
    except RecursionError:
        return None


def _field(ridged: bool | None):
    """simplex2d (None), fbm2d (False) and ridged2d (True): noise, scaled, clamped, and spread over the node's range."""

    def column(node: dict, floating, place, param) -> Column:
        px, py = place(node)
        skew = tuple(1.0 if abs(v) <= S.EPSILON else v for v in (param(node, "skewX", 1), param(node, "skewY", 1)))
        offset = param(node, "offsetX", 0), param(node, "offsetY", 0)
        seed, frequency = math.trunc(param(node, "seed", 1)), param(node, "frequency", 0.002)
        if ridged is None:
            raw = noise.simplex_column(seed, (px + offset[0]) * frequency / skew[0], (py + offset[1]) * frequency / skew[1]) * 0.5 + 0.5
        else:
            octaves = min(12, max(1, math.trunc(param(node, "octaves", 5))))
            raw = noise.fractal_column(seed, px, py, octaves, frequency, max(0.01, param(node, "lacunarity", 2)), max(0.0, param(node, "gain", 0.5)), skew, offset, ridged)
        low, high = param(node, "rangeMin", 0), param(node, "rangeMax", 1)
        return S.remap(S.bind(raw * param(node, "amplitude", 1), lambda v: S.clamp(v, 0, 1)), low, high)

    return column


#: How each node type becomes a Column; a new function is an entry here and one in the registry.
NODE_COLUMNS = {
    "constFloat": lambda n, f, p, g: F.lit(g(n, "value", 1)),
    "simplex2d": _field(None),
    "fbm2d": _field(False),
    "ridged2d": _field(True),
    "add": lambda n, f, p, g: f(n, "a", 0) + f(n, "b", 0),
    "subtract": lambda n, f, p, g: f(n, "a", 0) - f(n, "b", 0),
    "multiply": lambda n, f, p, g: f(n, "a", 1) * f(n, "b", 1),
    "divide": lambda n, f, p, g: S.bind(F.struct(f(n, "a", 1).alias("a"), f(n, "b", 1).alias("b")), lambda v: S.safe_divide(v["a"], v["b"])),
    "clamp": lambda n, f, p, g: S.bind(f(n, "in", 0), lambda v: S.clamp(v, g(n, "min", 0), g(n, "max", 1))),
    "power": lambda n, f, p, g: S.bind(f(n, "in", 0), lambda v: S.power(v, g(n, "exponent", 1))),
    "terrace": lambda n, f, p, g: S.bind(f(n, "in", 0), lambda v: S.terrace(v, g(n, "steps", 5), g(n, "softness", 0.18))),
    "smoothstep": lambda n, f, p, g: S.bind(f(n, "in", 0), lambda v: S.smoothstep(g(n, "edge0", 0), g(n, "edge1", 1), v)),
}


def evaluate(spark: SparkSession, graph: dict | None, x: float, y: float) -> float:
    """The field at one point; 0 without a field."""
    column = compile_graph(graph, F.lit(float(x)), F.lit(float(y)))
    return 0.0 if column is None else spark.range(1).select(column.alias("v")).first()["v"]


# --- many graphs as tables ---


def graph_tables(spark: SparkSession, graphs: list[dict]) -> tuple[DataFrame, DataFrame]:
    """nodes (graph_id, node_id, type, params) and edges (graph_id, ord, edge_id, from_node, from_port, to_node, to_port)."""
    nodes = [(g["id"], n["id"], n["type"], json.dumps(n["params"])) for g in graphs for n in g["nodes"]]
    edges = [(g["id"], i, e["id"], e["from"]["nodeId"], e["from"]["portId"], e["to"]["nodeId"], e["to"]["portId"]) for g in graphs for i, e in enumerate(g["edges"])]
    return (
        spark.createDataFrame(nodes, "graph_id string, node_id string, type string, params string"),
        spark.createDataFrame(edges, "graph_id string, ord int, edge_id string, from_node string, from_port string, to_node string, to_port string"),
    )


def validate_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, edge_id, message: validate() for any number of graphs, as joins with the port registry. A graph without nodes has no rows to be known by."""
    spark = nodes.sparkSession
    ports = port_table(spark)
    outputs = nodes.groupBy("graph_id").agg(F.count_if(F.col("type") == "output").alias("n")).where("n <> 1")
    out = outputs.select("graph_id", F.lit(None).cast("string").alias("edge_id"), F.lit(ONE_OUTPUT).alias("message"))
    known = nodes.select("graph_id", "node_id", "type").join(F.broadcast(ports), "type")

    def end(name: str) -> DataFrame:
        return known.select("graph_id", F.col("node_id").alias(f"{name}_node"), F.col("port").alias(f"{name}_port"), F.col("direction").alias(f"{name}_way"), F.col("value_type").alias(f"{name}_kind"))

    seen = edges.join(end("from"), ["graph_id", "from_node", "from_port"], "left").join(end("to"), ["graph_id", "to_node", "to_port"], "left")
    good = F.col("from_way").isNotNull() & F.col("to_way").isNotNull()
    first = F.min(F.when(good, F.struct("ord", "edge_id"))).over(Window.partitionBy("graph_id", "to_node", "to_port"))
    seen = seen.withColumn("again", good & (F.struct("ord", "edge_id") > first))
    messages = F.array_compact(
        F.array(
            F.when(~good, MISSING),
            F.when(good & ((F.col("from_way") != "output") | (F.col("to_way") != "input")), DIRECTION),
            F.when(good & (F.col("from_kind") != F.col("to_kind")), F.format_string("Cannot connect %s to %s.", "from_kind", "to_kind")),
            F.when(F.col("again"), ONE_EDGE),
        )
    )
    return out.unionByName(seen.select("graph_id", "edge_id", F.explode(messages).alias("message")))

