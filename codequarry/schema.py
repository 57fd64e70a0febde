"""Table schemas, value lists and id expressions of the code graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

# Fixed values of the data model.
NODE_KINDS = ["Project", "Package", "Namespace", "Module", "File", "Class", "Interface", "Struct", "Enum", "Trait", "Function", "Method", "Constructor", "Destructor", "Field", "Variable", "Parameter", "Block", "CurrentVersion"]
EDGE_KINDS = ["CONTAINS_PACKAGE", "CONTAINS_FILE", "CONTAINS_CLASS", "CONTAINS_METHOD", "CONTAINS_FUNCTION", "CONTAINS_FIELD", "CONTAINS_BLOCK", "HAS_PARAMETER", "IMPORTS", "INCLUDES", "CALLS", "INHERITS", "EXTENDS", "IMPLEMENTS", "INJECTS", "OVERRIDES", "DEPENDS_ON", "TYPES", "VIRTUAL_CALL", "LAMBDA_CALL", "CROSS_FILE_CALL"]
BLOCK_TYPES = ["if", "for", "while", "try", "lambda", "with", "match", "switch", "loop"]
LANGS = ["java", "cpp", "rust", "python", "typescript", "tsx", "go"]
CALL_KINDS = ["CALLS", "VIRTUAL_CALL", "LAMBDA_CALL", "CROSS_FILE_CALL"]
SUPER_KINDS = ["INHERITS", "EXTENDS", "IMPLEMENTS"]
CALLABLE_KINDS = ["Function", "Method", "Constructor", "Destructor"]
EMBEDDABLE_KINDS = ["Class", "Interface", "Struct", "Enum", "Trait", "Function", "Method", "Constructor", "Destructor"]


_TYPES: dict[str, DataType] = {"STRING": StringType(), "INT": IntegerType(), "BIGINT": LongType(), "DOUBLE": DoubleType(), "BOOLEAN": BooleanType(), "ARRAY<STRING>": ArrayType(StringType())}


def ddl(text: str) -> StructType:
    """A flat schema; unlike StructType.fromDDL this needs no session."""
    parts = [x.split() for x in text.split(", ")]
    return StructType([StructField(name, _TYPES[kind], not rest) for name, kind, *rest in parts])


NODES = ddl("id STRING NOT NULL, kind STRING, name STRING, qualified_name STRING, lang STRING, file_path STRING, start_line INT, end_line INT, start_byte BIGINT, end_byte BIGINT, code_hash STRING, signature STRING, project_id STRING, valid_from STRING, valid_to STRING")
EDGES = ddl("id STRING NOT NULL, kind STRING, from_id STRING, to_id STRING, label STRING, valid_from STRING, valid_to STRING, dep_kind STRING, raw_type_string STRING, confidence DOUBLE")
BLOCKS = ddl("id STRING NOT NULL, block_type STRING, name STRING, parent_function_id STRING, lang STRING, file_path STRING, start_line INT, end_line INT, start_byte BIGINT, end_byte BIGINT, nesting_depth INT, code_hash STRING, captured_variables ARRAY<STRING>, valid_from STRING, valid_to STRING")
FRAMES = ddl("trace_id STRING, frame_index INT, function_name STRING, class_name STRING, file_path STRING, line_number INT, column INT, language STRING, frame_type STRING, raw_line STRING, module STRING, is_native BOOLEAN, is_async BOOLEAN")


def _hash24(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 24)


def node_id(project: Column, path: Column, kind: Column, qualified: Column) -> Column:
    return _hash24(project, path, kind, qualified)


def edge_id(from_id: Column, kind: Column, to_id: Column, dep_kind: Column | None = None, raw_type: Column | None = None, confidence: Column | None = None) -> Column:
    """Missing optional parts count as '' and 0.0."""
    text = lambda c: F.coalesce(c, F.lit("")) if c is not None else F.lit("")
    number = F.coalesce(confidence, F.lit(0.0)) if confidence is not None else F.lit(0.0)
    return _hash24(from_id, kind, to_id, text(dep_kind), text(raw_type), number.cast("string"))


def block_id(path: Column, block_type: Column, parent: Column, start_line: Column) -> Column:
    return _hash24(path, block_type, parent, start_line.cast("string"))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 24)


def schema_gaps(actual: StructType, wanted: StructType) -> list[str]:
    """Columns that are wanted and absent or of another type."""
    have = {f.name: f.dataType for f in actual}
    return [f.name for f in wanted if have.get(f.name) != f.dataType]
