"""Schemas of the tables.  Every table has a graph_id, so many graphs are worked on at once."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
_STRINGS = T.ArrayType(_S)

LINES = _table(graph_id=_S, line_no=_I, text=_S)
CLASSES = _table(graph_id=_S, alias=_S, name=_S, kind=_S, body=_STRINGS, package=_S, stereotype=_S, decl_line=_I)
RELATIONS = _table(graph_id=_S, rel_id=_I, source=_S, arrow=_S, target=_S, label=_S, src_mult=_S, dst_mult=_S, raw=_S)
NODES = _table(graph_id=_S, alias=_S, in_degree=_L, out_degree=_L)
ADJACENCY = _table(graph_id=_S, u=_S, v=_S)
HUBS = _table(graph_id=_S, alias=_S, in_degree=_L, out_degree=_L, reason=_S, forced=_B, policy=_S)
MEMBERSHIP = _table(graph_id=_S, cluster_id=_I, cluster_name=_S, alias=_S)
DECISIONS = _table(graph_id=_S, stage=_S, chosen=_S, size=_L, prefix_cut=_L, leiden_cut=_L, prefix_satisfies=_B, leiden_satisfies=_B)

_DECLARATION = _table(alias=_S, name=_S, kind=_S, body=_STRINGS, package=_S, stereotype=_S, decl_line=_I)
_RELATION = _table(rel_id=_I, source=_S, arrow=_S, target=_S, label=_S, src_mult=_S, dst_mult=_S, raw=_S)
_LINE = _table(line_no=_I, text=_S)
DOCUMENTS = _table(graph_id=_S, start_line=_S, headers=_STRINGS, classes=T.ArrayType(_DECLARATION), relations=T.ArrayType(_RELATION), passthrough=T.ArrayType(_LINE), warnings=_STRINGS)
