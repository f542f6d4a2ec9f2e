"""Closed vocabularies of the graph: node kinds, edge types and their classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: node kinds in document order
NODE_KINDS = [
    "Solution", "Project", "File", "Namespace", "Type", "Method", "CodeChunk", "ExternalSymbol", "WebFormPage", "ScriptAsset", "FrontendBundle",
    "FrontendComponent", "FrontendFunction", "UIElement", "ApiEndpoint", "UnresolvedView", "View", "Database", "DatabaseObject", "DatabaseColumn",
    "StoredProcedureParameter", "ConnectionProfile", "Schedule", "ScheduleTaskInstance", "ScheduleTaskDefinition", "ReportTemplate", "ReportDocument",
    "ReportDataSource", "CustomParameterDataSource", "ReportParameter", "ResultColumn", "CsvFormat", "CategoryType", "MenuItem", "PluginReportTarget",
    "EfModel", "EfEntity", "DynamicStoredProcedureCall",
]
# fixed values: edge types in document order
EDGE_TYPES = [
    "CONTAINS_PROJECT", "REFERENCES_PROJECT", "CONTAINS_FILE", "DECLARES_NAMESPACE", "IMPORTS_NAMESPACE", "DECLARES_TYPE", "CONTAINS_TYPE",
    "DECLARES_METHOD", "CALLS", "INSTANTIATES", "DERIVES_FROM", "IMPLEMENTS", "OVERRIDES", "IMPLEMENTS_METHOD", "UNRESOLVED_BASE", "HAS_CHUNK",
    "CONTAINS_FRONTEND_ASSET", "REPRESENTS_SOURCE_FILE", "INCLUDES_SCRIPT", "DECLARES_COMPONENT", "DECLARES_FUNCTION", "COMPONENT_HAS_FUNCTION",
    "USES_UI_ELEMENT", "RENDERS_UI_ELEMENT", "CALLS_API", "IMPORTS_SCRIPT", "RETURNS_VIEW", "COMPILED_TO", "CONTAINS_OBJECT", "HAS_COLUMN",
    "HAS_PARAMETER", "FOREIGN_KEY_TO", "READS", "WRITES", "CALLS_UDF", "TARGETS_DATABASE", "USES_CONNECTION", "DEFINED_IN_PROJECT",
    "HAS_SCHEDULE_TASK", "RESOLVES_TO_TASK_DEFINITION", "EXECUTES_STORED_PROCEDURE", "CONTAINS_REPORT_DOCUMENT", "USES_DATA_SOURCE",
    "USES_CUSTOM_PARAMETER_SOURCE", "RETURNS_COLUMN", "MAPS_TO_CATEGORY_TYPE", "CHILD_OF", "NAVIGATES_TO_CONTROLLER", "NAVIGATES_TO_ACTION",
    "LINKS_TO_CUSTOM_REPORT", "LINKS_TO_PLUGIN_REPORT", "IMPLEMENTED_BY_TYPE", "CONTAINS_EF_MODEL", "DESCRIBES_ENTITY", "EF_MAPS_TO",
    "GENERATES_ENTITY_TYPE", "CUSTOM_MAPS_TO", "REFERENCES_DATABASE_OBJECT", "REFERENCES_STORED_PROCEDURE", "REFERENCES_UDF",
    "CALLS_STORED_PROCEDURE", "FILE_CALLS_STORED_PROCEDURE", "BINDS_PARAMETER", "DYNAMICALLY_CALLS_STORED_PROCEDURE", "RENDERS_VIEW",
]
# fixed values: edge types of weight 100 and 80; all others weigh 50
BACKBONE = [
    "CALLS", "INSTANTIATES", "DERIVES_FROM", "IMPLEMENTS", "OVERRIDES", "IMPLEMENTS_METHOD", "READS", "WRITES", "EXECUTES_STORED_PROCEDURE",
    "CALLS_STORED_PROCEDURE", "CALLS_UDF", "FOREIGN_KEY_TO", "LINKS_TO_PLUGIN_REPORT", "LINKS_TO_CUSTOM_REPORT", "NAVIGATES_TO_ACTION",
    "NAVIGATES_TO_CONTROLLER",
]
STRUCTURAL = [
    "RENDERS_VIEW", "RETURNS_VIEW", "CONTAINS_OBJECT", "CONTAINS_FRONTEND_ASSET",
]
# fixed values: the order of kinds in the degree ranking; all others come after
CENTRAL = [
    "MenuItem", "ApiEndpoint", "Method", "Type", "DatabaseObject",
]


def edge_weight(type_: Column) -> Column:
    return F.when(type_.isin(BACKBONE), 100).when(type_.isin(STRUCTURAL), 80).otherwise(50)


def central_priority(kind: Column) -> Column:
    return F.when(kind.isin(CENTRAL), F.array_position(F.array(*map(F.lit, CENTRAL)), kind) - 1).otherwise(len(CENTRAL)).cast("int")


def ordinal(values: list[str], column: Column) -> Column:
    """Place in document order, from 0; -1 for what the vocabulary doesn't have."""
    return (F.array_position(F.array(*map(F.lit, values)), column) - 1).cast("int")
