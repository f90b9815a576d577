"""Arrow schemas of Spark types."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)
