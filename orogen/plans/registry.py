"""The node registry of field graphs: types, ports and default parameters, as data and as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FLOAT, VEC2 = "float", "vec2"
_XY = [("x", FLOAT), ("y", FLOAT), ("xy", VEC2)]
_VALUE = [("value", FLOAT)]
_FIELD = {"frequency": 0.002, "amplitude": 1, "seed": 1, "skewX": 1, "skewY": 1, "offsetX": 0, "offsetY": 0, "rangeMin": 0, "rangeMax": 1}
_FRACTAL = {"octaves": 5, "lacunarity": 2}

# Type, label, category, inputs, outputs, default parameters.
NODES = {
    "output": ("Output", "Output", _VALUE, [], {}),
    "constFloat": ("Float", "Inputs", [], _VALUE, {"value": 1}),
    "cartesianPosition": ("Cartesian Position", "Inputs", [], _XY, {}),
    "simplex2d": ("Simplex 2D", "Noise", _XY, _VALUE, _FIELD),
    "fbm2d": ("fBM 2D", "Noise", _XY, _VALUE, _FIELD | _FRACTAL | {"frequency": 0.0015, "seed": 2, "gain": 0.5}),
    "ridged2d": ("Ridged 2D", "Noise", _XY, _VALUE, _FIELD | _FRACTAL | {"frequency": 0.0025, "seed": 3, "gain": 0.48}),
    "add": ("Add", "Math", [("a", FLOAT), ("b", FLOAT)], _VALUE, {"a": 0, "b": 0}),
    "subtract": ("Subtract", "Math", [("a", FLOAT), ("b", FLOAT)], _VALUE, {"a": 0, "b": 0}),
    "multiply": ("Multiply", "Math", [("a", FLOAT), ("b", FLOAT)], _VALUE, {"a": 1, "b": 1}),
    "divide": ("Divide", "Math", [("a", FLOAT), ("b", FLOAT)], _VALUE, {"a": 1, "b": 1}),
    "clamp": ("Clamp", "Math", [("in", FLOAT)], _VALUE, {"min": 0, "max": 1}),
    "power": ("Power", "Math", [("in", FLOAT)], _VALUE, {"exponent": 1}),
    "terrace": ("Terrace", "Math", [("in", FLOAT)], _VALUE, {"steps": 5, "softness": 0.18}),
    "smoothstep": ("Smoothstep", "Math", [("in", FLOAT)], _VALUE, {"edge0": 0, "edge1": 1}),
}


def port(node_type: str, port_id: str) -> tuple[str, str] | None:
    """(direction, value type) of a port; inputs come first where a name is both."""
    if node_type not in NODES:
        return None
    _, _, inputs, outputs, _ = NODES[node_type]
    for direction, ports in (("input", inputs), ("output", outputs)):
        for name, kind in ports:
            if name == port_id:
                return direction, kind
    return None


def node_table(spark: SparkSession) -> DataFrame:
    """type, label, category, params: the registry as a table."""
    rows = [(t, label, category, {k: str(v) for k, v in params.items()}) for t, (label, category, _, _, params) in NODES.items()]
    return spark.createDataFrame(rows, "type string, label string, category string, params map<string,string>")


def port_table(spark: SparkSession) -> DataFrame:
    """type, port, direction, value_type: every port of every node type."""
    rows = [(t, name, direction, kind) for t, n in NODES.items() for direction, ports in (("input", n[2]), ("output", n[3])) for name, kind in ports]
    return spark.createDataFrame(rows, "type string, port string, direction string, value_type string")
