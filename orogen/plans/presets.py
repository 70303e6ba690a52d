"""The built-in field graphs."""

from __future__ import annotations

# Name, description, nodes (id: type, place in the editor, stored parameters) and edges
# (from node, from port, to node, to port) of each preset.
PRESETS = {
    "preset-plains": (
        "Plains",
        "Very low relief with broad 10k-foot swells and faint thousand-foot surface texture.",
        {
            "plains-position": ("cartesianPosition", (60, 140), {}),
            "plains-broad": ("fbm2d", (295, 80), {"frequency": 0.00008, "octaves": 3, "lacunarity": 2, "gain": 0.45, "seed": 31, "skewX": 1, "skewY": 1, "rangeMin": -1, "rangeMax": 1}),
            "plains-broad-weight": ("constFloat", (295, 205), {"value": 0.55}),
            "plains-broad-scaled": ("multiply", (515, 105), {}),
            "plains-texture": ("fbm2d", (295, 355), {"frequency": 0.00065, "octaves": 3, "lacunarity": 2.1, "gain": 0.35, "seed": 37, "skewX": 1, "skewY": 1, "rangeMin": -1, "rangeMax": 1}),
            "plains-texture-weight": ("constFloat", (295, 480), {"value": 0.1}),
            "plains-texture-scaled": ("multiply", (515, 380), {}),
            "plains-sum": ("add", (735, 225), {}),
            "plains-output": ("output", (940, 225), {}),
        },
        [
            ("plains-position", "xy", "plains-broad", "xy"),
            ("plains-position", "xy", "plains-texture", "xy"),
            ("plains-broad", "value", "plains-broad-scaled", "a"),
            ("plains-broad-weight", "value", "plains-broad-scaled", "b"),
            ("plains-texture", "value", "plains-texture-scaled", "a"),
            ("plains-texture-weight", "value", "plains-texture-scaled", "b"),
            ("plains-broad-scaled", "value", "plains-sum", "a"),
            ("plains-texture-scaled", "value", "plains-sum", "b"),
            ("plains-sum", "value", "plains-output", "value"),
        ],
    ),
    "preset-rolling-hills": (
        "Rolling Hills",
        "Low rounded terrain undulations.",
        {
            "rolling-position": ("cartesianPosition", (60, 140), {}),
            "rolling-fbm": ("fbm2d", (300, 105), {"frequency": 0.00038, "octaves": 5, "lacunarity": 2, "gain": 0.5, "seed": 71, "rangeMin": -1, "rangeMax": 1}),
            "rolling-output": ("output", (540, 130), {}),
        },
        [
            ("rolling-position", "xy", "rolling-fbm", "xy"),
            ("rolling-fbm", "value", "rolling-output", "value"),
        ],
    ),
    "preset-dunes": (
        "Dunes",
        "Wind-stretched dune bands with 150-800 foot wavelengths and gentle drift variation.",
        {
            "dunes-position": ("cartesianPosition", (60, 140), {}),
            "dunes-bands": ("ridged2d", (295, 95), {"frequency": 0.0033, "octaves": 4, "lacunarity": 1.75, "gain": 0.42, "seed": 143, "skewX": 2.6, "skewY": 0.55, "rangeMin": -1, "rangeMax": 1}),
            "dunes-band-weight": ("constFloat", (295, 220), {"value": 0.72}),
            "dunes-bands-scaled": ("multiply", (515, 120), {}),
            "dunes-drift": ("fbm2d", (295, 370), {"frequency": 0.00035, "octaves": 4, "lacunarity": 2, "gain": 0.48, "seed": 149, "skewX": 1.8, "skewY": 0.8, "rangeMin": -1, "rangeMax": 1}),
            "dunes-drift-weight": ("constFloat", (295, 495), {"value": 0.28}),
            "dunes-drift-scaled": ("multiply", (515, 395), {}),
            "dunes-sum": ("add", (735, 245), {}),
            "dunes-output": ("output", (940, 245), {}),
        },
        [
            ("dunes-position", "xy", "dunes-bands", "xy"),
            ("dunes-position", "xy", "dunes-drift", "xy"),
            ("dunes-bands", "value", "dunes-bands-scaled", "a"),
            ("dunes-band-weight", "value", "dunes-bands-scaled", "b"),
            ("dunes-drift", "value", "dunes-drift-scaled", "a"),
            ("dunes-drift-weight", "value", "dunes-drift-scaled", "b"),
            ("dunes-bands-scaled", "value", "dunes-sum", "a"),
            ("dunes-drift-scaled", "value", "dunes-sum", "b"),
            ("dunes-sum", "value", "dunes-output", "value"),
        ],
    ),
    "preset-mountains": (
        "Medium Mountains",
        "Broad mountain ranges with multi-thousand-foot massing and roughly 1,500-foot ridge structure.",
        {
            "mountains-position": ("cartesianPosition", (60, 140), {}),
            "mountains-ridge": ("ridged2d", (295, 70), {"frequency": 0.00065, "octaves": 5, "lacunarity": 1.9, "gain": 0.42, "seed": 219, "rangeMin": 0, "rangeMax": 1}),
            "mountains-mask": ("fbm2d", (295, 245), {"frequency": 0.00018, "octaves": 4, "lacunarity": 2, "gain": 0.48, "seed": 220, "rangeMin": 0.38, "rangeMax": 1}),
            "mountains-multiply": ("multiply", (530, 135), {}),
            "mountains-power": ("power", (720, 135), {"exponent": 1.08}),
            "mountains-output": ("output", (910, 135), {}),
        },
        [
            ("mountains-position", "xy", "mountains-ridge", "xy"),
            ("mountains-position", "xy", "mountains-mask", "xy"),
            ("mountains-ridge", "value", "mountains-multiply", "a"),
            ("mountains-mask", "value", "mountains-multiply", "b"),
            ("mountains-multiply", "value", "mountains-power", "in"),
            ("mountains-power", "value", "mountains-output", "value"),
        ],
    ),
    "preset-himalayas": (
        "Himalayas",
        "Tall ridged ranges with mile-scale massifs, thousand-foot ridge structure, and restrained sharp detail.",
        {
            "himalayas-position": ("cartesianPosition", (60, 140), {}),
            "himalayas-massif": ("fbm2d", (295, 55), {"frequency": 0.00014, "octaves": 4, "lacunarity": 1.95, "gain": 0.5, "seed": 401, "skewX": 1.35, "skewY": 0.9, "rangeMin": 0.32, "rangeMax": 1}),
            "himalayas-ridges": ("ridged2d", (295, 235), {"frequency": 0.0009, "octaves": 6, "lacunarity": 1.9, "gain": 0.4, "seed": 409, "skewX": 1.15, "skewY": 0.85, "rangeMin": 0, "rangeMax": 1}),
            "himalayas-multiply": ("multiply", (535, 150), {}),
            "himalayas-power": ("power", (735, 150), {"exponent": 1.22}),
            "himalayas-detail": ("fbm2d", (535, 390), {"frequency": 0.0018, "octaves": 3, "lacunarity": 2.1, "gain": 0.34, "seed": 419, "skewX": 1, "skewY": 1, "rangeMin": -1, "rangeMax": 1}),
            "himalayas-detail-weight": ("constFloat", (735, 500), {"value": 0.055}),
            "himalayas-detail-scaled": ("multiply", (935, 405), {}),
            "himalayas-sum": ("add", (1135, 245), {}),
            "himalayas-clamp": ("clamp", (1335, 245), {"min": 0, "max": 1}),
            "himalayas-output": ("output", (1535, 245), {}),
        },
        [
            ("himalayas-position", "xy", "himalayas-massif", "xy"),
            ("himalayas-position", "xy", "himalayas-ridges", "xy"),
            ("himalayas-position", "xy", "himalayas-detail", "xy"),
            ("himalayas-massif", "value", "himalayas-multiply", "a"),
            ("himalayas-ridges", "value", "himalayas-multiply", "b"),
            ("himalayas-multiply", "value", "himalayas-power", "in"),
            ("himalayas-detail", "value", "himalayas-detail-scaled", "a"),
            ("himalayas-detail-weight", "value", "himalayas-detail-scaled", "b"),
            ("himalayas-power", "value", "himalayas-sum", "a"),
            ("himalayas-detail-scaled", "value", "himalayas-sum", "b"),
            ("himalayas-sum", "value", "himalayas-clamp", "in"),
            ("himalayas-clamp", "value", "himalayas-output", "value"),
        ],
    ),
    "preset-canyon": (
        "Canyon",
        "Thresholded canyon incision with clear plateau, softened strata, tributary cuts, and subtle sediment detail.",
        {
            "canyon-position": ("cartesianPosition", (60, 140), {}),
            "canyon-main-incision": ("ridged2d", (285, 110), {"frequency": 0.0005, "octaves": 5, "lacunarity": 1.88, "gain": 0.46, "seed": 341, "skewX": 1, "skewY": 1, "rangeMin": 0, "rangeMax": 1}),
            "canyon-main-threshold": ("smoothstep", (505, 120), {"edge0": 0.62, "edge1": 0.96}),
            "canyon-main-terraces": ("terrace", (725, 130), {"steps": 11, "softness": 0.44}),
            "canyon-main-weight": ("constFloat", (725, 235), {"value": 0.88}),
            "canyon-main-carve": ("multiply", (925, 145), {}),
            "canyon-tributary-incision": ("ridged2d", (285, 360), {"frequency": 0.00115, "octaves": 4, "lacunarity": 2.08, "gain": 0.38, "seed": 547, "skewX": 1, "skewY": 1, "rangeMin": 0, "rangeMax": 1}),
            "canyon-tributary-threshold": ("smoothstep", (505, 370), {"edge0": 0.7, "edge1": 0.98}),
            "canyon-tributary-power": ("power", (725, 380), {"exponent": 1.35}),
            "canyon-tributary-weight": ("constFloat", (725, 485), {"value": 0.22}),
            "canyon-tributary-carve": ("multiply", (925, 395), {}),
            "canyon-sediment-roughness": ("fbm2d", (285, 610), {"frequency": 0.0044, "octaves": 4, "lacunarity": 2.05, "gain": 0.42, "seed": 811, "skewX": 1, "skewY": 1, "rangeMin": 0, "rangeMax": 1}),
            "canyon-sediment-weight": ("constFloat", (505, 715), {"value": 0.055}),
            "canyon-sediment-detail": ("multiply", (725, 625), {}),
            "canyon-weathering-noise": ("fbm2d", (285, 850), {"frequency": 0.018, "octaves": 3, "lacunarity": 2.25, "gain": 0.36, "seed": 1217, "skewX": 1, "skewY": 1, "rangeMin": -1, "rangeMax": 1}),
            "canyon-weathering-weight": ("constFloat", (505, 955), {"value": 0.025}),
            "canyon-weathering-detail": ("multiply", (725, 865), {}),
            "canyon-sum-main-tributary": ("add", (1135, 220), {}),
            "canyon-incision-mask": ("smoothstep", (1335, 230), {"edge0": 0.06, "edge1": 0.42}),
            "canyon-masked-sediment": ("multiply", (925, 610), {}),
            "canyon-sum-sediment": ("add", (1535, 345), {}),
            "canyon-sum-all": ("add", (1735, 470), {}),
            "canyon-clamp": ("clamp", (1935, 480), {"min": 0, "max": 0.96}),
            "canyon-scale": ("constFloat", (1935, 585), {"value": -1}),
            "canyon-carve": ("multiply", (2135, 490), {}),
            "canyon-output": ("output", (2335, 500), {}),
        },
        [
            ("canyon-position", "xy", "canyon-main-incision", "xy"),
            ("canyon-position", "xy", "canyon-tributary-incision", "xy"),
            ("canyon-position", "xy", "canyon-sediment-roughness", "xy"),
            ("canyon-position", "xy", "canyon-weathering-noise", "xy"),
            ("canyon-main-incision", "value", "canyon-main-threshold", "in"),
            ("canyon-main-threshold", "value", "canyon-main-terraces", "in"),
            ("canyon-main-terraces", "value", "canyon-main-carve", "a"),
            ("canyon-main-weight", "value", "canyon-main-carve", "b"),
            ("canyon-tributary-incision", "value", "canyon-tributary-threshold", "in"),
            ("canyon-tributary-threshold", "value", "canyon-tributary-power", "in"),
            ("canyon-tributary-power", "value", "canyon-tributary-carve", "a"),
            ("canyon-tributary-weight", "value", "canyon-tributary-carve", "b"),
            ("canyon-sediment-roughness", "value", "canyon-sediment-detail", "a"),
            ("canyon-sediment-weight", "value", "canyon-sediment-detail", "b"),
            ("canyon-weathering-noise", "value", "canyon-weathering-detail", "a"),
            ("canyon-weathering-weight", "value", "canyon-weathering-detail", "b"),
            ("canyon-main-carve", "value", "canyon-sum-main-tributary", "a"),
            ("canyon-tributary-carve", "value", "canyon-sum-main-tributary", "b"),
            ("canyon-sum-main-tributary", "value", "canyon-incision-mask", "in"),
            ("canyon-sediment-detail", "value", "canyon-masked-sediment", "a"),
            ("canyon-incision-mask", "value", "canyon-masked-sediment", "b"),
            ("canyon-sum-main-tributary", "value", "canyon-sum-sediment", "a"),
            ("canyon-masked-sediment", "value", "canyon-sum-sediment", "b"),
            ("canyon-sum-sediment", "value", "canyon-sum-all", "a"),
            ("canyon-weathering-detail", "value", "canyon-sum-all", "b"),
            ("canyon-sum-all", "value", "canyon-clamp", "in"),
            ("canyon-clamp", "value", "canyon-carve", "a"),
            ("canyon-scale", "value", "canyon-carve", "b"),
            ("canyon-carve", "value", "canyon-output", "value"),
        ],
    ),
}


def preset(graph_id: str) -> dict:
    """One built-in graph, with the parameters that it stores and no defaults filled in."""
    name, description, listed, wires = PRESETS[graph_id]
    nodes = [{"id": i, "type": t, "position": {"x": x, "y": y}, "params": dict(p)} for i, (t, (x, y), p) in listed.items()]
    edges = [{"id": f"edge-{a}-{p}-{b}-{q}", "from": {"nodeId": a, "portId": p}, "to": {"nodeId": b, "portId": q}} for a, p, b, q in wires]
    return {"version": 1, "id": graph_id, "name": name, "description": description, "nodes": nodes, "edges": edges}


def presets() -> list[dict]:
    """The built-in library, in its fixed order."""
    return [preset(i) for i in PRESETS]
