"""Closed vocabularies and table schemas of the property graph."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: symbol types and their roles ---------------------------------------------------------------------
DOC_TYPES = (
    "markdown_document", "markdown_section", "restructuredtext_document", "asciidoc_document", "plaintext_document", "document_document", "pdf_document", "html_document", "xml_document",
    "json_document", "yaml_document", "toml_document", "config_document", "build_config_document", "schema_document", "infrastructure_document", "script_document", "text_chunk", "text_document",
)
CODE_ARCHITECTURAL = ("class", "interface", "struct", "enum", "trait", "function", "constant", "type_alias", "macro")
ARCHITECTURAL_TYPES = CODE_ARCHITECTURAL + DOC_TYPES
EXPANSION_TYPES = (*CODE_ARCHITECTURAL, "module_doc", "file_doc")
IDENTITY_TYPES = ("class", "interface", "trait", "protocol", "enum", "struct", "record", "module", "namespace", "function")
TYPE_PRIORITY = {
    "class": 10, "interface": 10, "trait": 10, "protocol": 10, "enum": 9, "struct": 9, "record": 9, "module": 8, "namespace": 8, "function": 7,
    "constant": 6, "type_alias": 6, "macro": 6, "method": 3, "property": 2, "module_doc": 1, "file_doc": 1,
}
CONFIDENCE_RANK = {"EXTRACTED": 3, "INFERRED": 2, "AMBIGUOUS": 1}
SYNTHETIC_CLASSES = ("directory", "lexical", "semantic", "doc", "bridge", "cross_language", "test_link", "cross_repo")
CALIBRATED_CLASSES = ("cross_language", "test_link", "cross_repo")
SYNTHETIC_FLOOR = 0.5
#: Informal edge types and the types they stand for.
EDGE_ALIASES = {
    "inherits": "inheritance", "extends": "inheritance", "implements": "implementation", "invokes": "calls", "has_member": "contains", "has_method": "contains", "composes": "composition",
    "constructs": "creates", "accesses": "reads", "modifies": "writes", "file_imports": "imports", "implements_interface": "implementation", "field_type": "uses_type",
}
ENTRY_NAMES = ("main", "run", "execute", "start", "cli", "app", "serve", "setup", "bootstrap", "entrypoint", "entry_point")
INFRA_SEGMENTS = ("config", "configs", "configuration", "util", "utils", "utility", "utilities", "helper", "helpers", "middleware", "logging", "logger", "common", "shared", "base")
INTERNAL_SEGMENTS = ("internal", "_internal", "private", "_private", "impl", "_impl", "detail", "_detail")
#: Path shapes of test code, matched without regard to case.
TEST_PATHS = (
    r"(^|/)tests?/", r"(^|/)__tests__/", r"(^|/)specs?/", r"(^|/)testing/", r"(^|/)test_?helpers?/", r"(^|/)fixtures/", r"(^|/)mocks?/", r"(^|/)testdata/", r"(^|/)testutils?/",
    r"(^|/)test_[^/]+\.\w+$", r"(^|/)[^/]+_test\.\w+$", r"(^|/)[^/]+\.test\.\w+$", r"(^|/)[^/]+\.spec\.\w+$", r"(^|/)[^/]+Tests?\.\w+$", r"(^|/)conftest\.py$", r"(^|/)setup_tests?\.\w+$",
)
#: LIKE patterns of vendored paths ('_' is a wildcard, case is disregarded).
VENDORED_LIKE = (
    "third_party/%", "third-party/%", "vendor/%", "vendored/%", "external/%", "extern/%", "deps/%", "%/third_party/%", "%/third-party/%", "%/vendor/%", "%/vendored/%", "%/external/%",
    "%/gtest/%", "%/gmock/%", "%/googletest/%", "%/googlemock/%",
)

NODE_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("wiki_id", "node_id", "rel_path", "file_name", "language")]
    + [T.StructField(n, T.IntegerType()) for n in ("start_line", "end_line")]
    + [T.StructField(n, T.StringType()) for n in ("symbol_name", "symbol_type", "parent_symbol", "analysis_level", "source_text", "docstring", "signature", "parameters", "return_type", "content_hash", "embedding_content_hash")]
    + [T.StructField(n, T.IntegerType()) for n in ("is_architectural", "is_doc", "is_test")]
    + [T.StructField("chunk_type", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in ("macro_cluster", "micro_cluster", "is_hub")]
    + [T.StructField(n, T.StringType()) for n in ("hub_assignment", "api_surface")]
    + [T.StructField("indexed_at", T.TimestampType())]
)
EDGE_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("wiki_id", "source_id", "target_id", "rel_type", "edge_class", "analysis_level", "confidence")]
    + [T.StructField(n, T.DoubleType()) for n in ("weight", "raw_similarity")]
    + [T.StructField(n, T.StringType()) for n in ("source_file", "target_file", "language", "annotations", "created_by", "provenance")]
    + [T.StructField("recorded_at", T.TimestampType())]
)
