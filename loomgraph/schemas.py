"""Explicit schemas of the logical tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, L, I, SHORT, D = T.StringType(), T.LongType(), T.IntegerType(), T.ShortType(), T.DoubleType()

NODES = _schema(node_id=S, node_domain=S, node_name=S, node_domain_id=S)
EDGES = _schema(subject_id=S, subject_domain=S, relation_type=S, object_id=S, object_domain=S, year=SHORT, number_of_occurrences=I)
RELATIONS = _schema(pmid=L, relation_type=S, domain_pipe_subject_id_raw=S, domain_pipe_object_id_raw=S)
FACTS = _schema(s=L, r=L, o=L, t=L, split=S)
PUBLICATIONS = _schema(pmid=S, year=I, title=S, abstract=S, doi=S, citations_count=I, authors=T.ArrayType(_schema(first_name=S, last_name=S)))
LINKS = _schema(pmid=S, node_id=S)
_INFONS = _schema(name=S, type=S, identifier=S, year=S)
_ANNOTATION = _schema(infons=_INFONS, text=S, locations=T.ArrayType(_schema(offset=I, length=I)))
ANNOTATED = _schema(id=S, passages=T.ArrayType(_schema(infons=_INFONS, text=S, annotations=T.ArrayType(_ANNOTATION))))
EDGE_CACHE = _schema(node_id=S, years=T.ArrayType(S))
