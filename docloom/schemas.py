"""Fixed schemas: nothing is inferred anywhere."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, B, D = T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ITEM = struct(text=S, text_original=S, level=I, depth=I)
DEFINITION = struct(term=S, definition=S)
ROWS = T.ArrayType(T.ArrayType(S))
RAW_BLOCK = struct(
    type=S,
    text=S,
    text_original=S,
    level=I,
    ordered=B,
    items=T.ArrayType(ITEM),
    rows=ROWS,
    rows_original=ROWS,
    language=S,
    filename=S,
    line_count=I,
    functions=T.ArrayType(S),
    classes=T.ArrayType(S),
    imports=T.ArrayType(S),
    term=S,
    definition=S,
    definitions=T.ArrayType(DEFINITION),
    src=S,
    alt=S,
    caption=S,
    page_number=I,
    source_location=S,
    confidence=D,
)
META = T.MapType(S, S)
