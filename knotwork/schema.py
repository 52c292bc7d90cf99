"""Data model: triples, vocabularies and the row types of sources."""

from __future__ import annotations

from pyspark.sql import types as T

#: Name space of the project's predicates and classes.
KG = "http://example.org/kg/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def _struct(**fields: str) -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "strings": T.ArrayType(T.StringType()), "doubles": T.ArrayType(T.DoubleType())}
    return T.StructType([T.StructField(k, kinds[v]) for k, v in fields.items()])


TRIPLE = _struct(graph="string", s="string", s_kind="string", p="string", o="string", o_kind="string", o_datatype="string", o_lang="string")
QUAD = _struct(s="string", p="string", o="string", idx="string")
METADATA = _struct(dir_name="string", title="string", framework="string", lightweight="string", err_msg="string", pdate="string", tags="string", stars="int", code_link="string", paper_link="string")
ENTITY = _struct(doc="string", id="string", type="string", start="int", end="int", text="string")
RELATION = _struct(doc="string", id="string", rel="string", arg1="string", arg2="string")
PAPERS_CSV = _struct(paper_title="string", paper_link="string", conference="string", year="int", Platform="string", repo_link="string")
EMBEDDING = _struct(row="long", vec="doubles")
