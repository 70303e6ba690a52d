"""Schemas of the tables and documents."""

from __future__ import annotations

ANCHOR = "struct<id:string,x:double,z:double>"
PRIMITIVE = (
    f"id string, ord int, type string, name string, enabled boolean, createdAt string, updatedAt string, mode string, elevation double, noiseScale double, "
    f"priority double, height double, width double, fieldId string, edgeSmoothness double, splineSmoothness double, anchors array<{ANCHOR}>"
)
WORLD = (
    "id string, name string, tileSize double, unitSize double, unit string, tilesPerSide double, worldHeight double, "
    "water struct<visible:boolean,level:double>, createdAt string, updatedAt string, version int"
)
BAKE = "id string, startedAt string, completedAt string, status string, inputHash string, primitiveCount int, tileCount int, error string"
REGISTRY = "id string, name string, updatedAt string, path string"
