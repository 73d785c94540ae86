"""Types of parsed documents; built without a session, so that modules can be imported anywhere."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, MapType, StringType, StructField, StructType

_S, _B, _I = StringType(), BooleanType(), IntegerType()


def struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


HEADING = struct(level=_I, text=_S)
LINK = struct(href=_S, text=_S, rel=_S)
IMAGE = struct(src=_S, alt=_S)
ALTERNATE = struct(href=_S, lang=_S)
NODE = struct(is_object=_B, has_context=_B, has_type=_B, types=ArrayType(_S), has_author=_B, has_date=_B)
DIAGNOSTIC = struct(message=_S, severity=_S, kind=_S, line=_I, block=_I, path=_S)
FACTS = struct(nodes=ArrayType(NODE), errors=ArrayType(_S), diagnostics=ArrayType(DIAGNOSTIC), block_count=_I)
SIGNALS = struct(diversity=DoubleType(), hits=_I)
PARSED = StructType(
    struct(
        document_title=_S, titles=ArrayType(_S), title=_S, headings=ArrayType(HEADING), paragraphs=ArrayType(_S), meta=MapType(_S, _S),
        meta_values=MapType(_S, ArrayType(_S)), links=ArrayType(LINK), images=ArrayType(IMAGE), language=_S, canonicals=ArrayType(_S), base_href=_S,
        alternates=ArrayType(ALTERNATE), raw_text=_S,
    ).fields
    + FACTS.fields
)
