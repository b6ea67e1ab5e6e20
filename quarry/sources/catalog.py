"""The tables of a code index and of a games base: declared schemas, typed empty tables, Parquet storage.

A catalog is a mapping of names to DataFrames.  Ids are longs that the loader
derives from natural keys, so a rerun gives the same ids in any order.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The tables and their columns.  Every table but those marked has a long `id` first.
SCHEMAS = {
    "scan_runs": "root_path string, started_at timestamp, finished_at timestamp, status string, files_scanned int, files_indexed int, errors_count int",
    "files": "scan_run_id long, path string, rel_path string, extension string, size_bytes long, hash_sha256 string, modified_at timestamp, encoding string, language string, created_at timestamp, updated_at timestamp",
    "symbols": "file_id long, symbol_name string, symbol_type string, entity_type string, entity_id long, line_number int, signature string",
    "sql_procedures": "file_id long, proc_name string, parameters array<struct<name:string,type:string,direction:string>>, line_start int, line_end int, body_hash string",
    "sql_tables": "file_id long, table_name string, context string, is_temporary boolean, line_number int, column_number int",
    "sql_columns": "file_id long, table_name string, column_name string, line_number int, column_number int",
    "sql_column_definitions": "file_id long, table_name string, column_name string, data_type string, definition_kind string, line_number int, column_order int",
    "sql_index_definitions": "file_id long, table_name string, index_name string, index_fields string, index_type string, is_unique boolean, definition_kind string, line_number int",
    "sql_index_definition_fields": "table_index_id long, field_name string, field_order int, line_number int",
    "pas_units": "file_id long, unit_name string, interface_uses array<string>, implementation_uses array<string>, line_start int, line_end int",
    "pas_classes": "unit_id long, class_name string, parent_class string, dfm_form_id long, line_start int, line_end int",
    "pas_methods": "class_id long, unit_id long, method_name string, signature string, visibility string, line_number int",
    "pas_fields": "class_id long, field_name string, field_type string, dfm_component_id long, visibility string, line_number int",
    "h_files_defines": "file_id long, define_name string, define_value string, define_type string, line_number int",
    "include_directives": "file_id long, include_path string, resolved_file_id long, line_number int",
    "js_functions": "file_id long, function_name string, signature string, line_start int, line_end int, scenario_type string, parent_object string",
    "smf_instruments": "file_id long, instrument_name string, brief string, deal_object_id long, ds_module_id long, start_state string, scenario_type string, states array<map<string,string>>, actions array<map<string,string>>, accounts array<map<string,string>>",
    "dfm_forms": "file_id long, form_name string, form_class string, caption string, line_start int, line_end int",
    "dfm_components": "file_id long, form_id long, component_name string, component_type string, parent_name string, caption string, line_start int, line_end int",
    "report_forms": "file_id long, report_name string, report_type string, form_name string, form_class string, line_start int, line_end int",
    "report_fields": "report_form_id long, field_name string, source_name string, format_mask string, options array<string>, line_number int, raw_text string",
    "report_params": "report_form_id long, param_name string, param_kind string, component_type string, data_type string, lookup_form string, lookup_table string, lookup_column string, key_column string, required boolean, default_value string, line_number int, raw_text string",
    "vb_functions": "report_form_id long, function_name string, function_type string, signature string, body_text string, line_start int, line_end int, body_hash string",
    "query_fragments": "file_id long, parent_type string, parent_id long, component_name string, component_type string, query_text string, query_hash string, tables_referenced array<string>, context string, line_number int",
    "api_business_objects": "file_id long, business_object string, module_name string, line_start int, line_end int",
    "api_contracts": "file_id long, business_object_id long, business_object string, contract_name string, contract_kind string, object_type_id int, object_name_id int, api_version string, arch_approval boolean, implemented boolean, internal_use boolean, deprecated boolean, is_external boolean, owner_module string, used_object_name string, used_module_sys_name string, short_description string, full_description string, line_start int, line_end int",
    "api_contract_params": "contract_id long, direction string, param_name string, prm_sub_object string, type_name string, required boolean, rus_name string, description string, ws_param_name string, param_order int, is_virtual_link boolean, line_number int",
    "api_contract_tables": "contract_id long, direction string, table_name string, ws_param_name string, required boolean, rus_name string, description string, param_order int, line_number int",
    "api_contract_table_fields": "contract_table_id long, field_name string, type_name string, required boolean, rus_name string, description string, ws_param_name string, param_order int, line_number int",
    "api_business_object_params": "file_id long, business_object string, param_name string, prm_sub_object string, type_name string, ws_param_name string, rus_name string, description string, line_number int",
    "api_business_object_tables": "file_id long, business_object string, table_name string, type_name string, ws_param_name string, rus_name string, description string, line_number int",
    "api_business_object_table_fields": "business_table_id long, field_name string, type_name string, ws_param_name string, rus_name string, description string, param_order int, line_number int",
    "api_business_object_table_indexes": "business_table_id long, index_name string, index_fields string, index_type int, is_clustered boolean, line_number int",
    "api_business_object_table_index_fields": "table_index_id long, field_name string, field_order int, line_number int",
    "api_contract_return_values": "contract_id long, value string, return_type string, description string, line_number int",
    "api_contract_contexts": "contract_id long, context_name string, type_name string, rus_name string, description string, context_order int, context_value string, is_virtual_link boolean, line_number int",
    "api_macro_invocations": "file_id long, procedure_name string, macro_type string, target_name string, target_kind string, line_number int, raw_text string",
    "relations": "source_type string, source_id long, target_type string, target_id long, relation_type string, confidence string, line_number int",
    "games": "id string, white_player string, black_player string, result string, eco_code string, pgn_content string, processed boolean, created_at timestamp, updated_at timestamp",
    "positions": "position_hash long, fen string, created_at timestamp",
    "moves": "parent_hash long, child_hash long, move_number int, move_from short, move_to short, piece_type short, color short, annotation short, rating double, games_count int, wins int, draws int, losses int, eco_code string, created_at timestamp",
    "eco_codes": "code string, name string, moves string, family string",
    "processed_files": "id string, filename string, file_path string, processed_at timestamp, games_count int, positions_count int, file_size long, status string",
}
#: Tables whose key is a column of their own.
OWN_KEY = {"games", "eco_codes", "processed_files"}

# The files' children go with a file, the others with their parent.
PARENTS = {
    "sql_index_definition_fields": ("sql_index_definitions", "table_index_id"), "dfm_components": ("dfm_forms", "form_id"), "report_fields": ("report_forms", "report_form_id"),
    "report_params": ("report_forms", "report_form_id"), "vb_functions": ("report_forms", "report_form_id"), "pas_classes": ("pas_units", "unit_id"), "pas_methods": ("pas_units", "unit_id"), "pas_fields": ("pas_classes", "class_id"),
    "api_contract_params": ("api_contracts", "contract_id"), "api_contract_tables": ("api_contracts", "contract_id"), "api_contract_table_fields": ("api_contract_tables", "contract_table_id"),
    "api_business_object_table_fields": ("api_business_object_tables", "business_table_id"), "api_business_object_table_indexes": ("api_business_object_tables", "business_table_id"),
    "api_business_object_table_index_fields": ("api_business_object_table_indexes", "table_index_id"), "api_contract_return_values": ("api_contracts", "contract_id"), "api_contract_contexts": ("api_contracts", "contract_id"),
}


def schema(name: str) -> str:
    return SCHEMAS[name] if name in OWN_KEY else f"id long, {SCHEMAS[name]}"


@cache
def _struct(name: str) -> StructType:
    return StructType.fromDDL(schema(name))


def key(*parts: Column | str) -> Column:
    """A long id from a natural key: positive, the same in every run.

    63 bits of a hash: among a thousand million rows of a table two collide with a chance of one in eighteen; ``collisions`` finds them."""
    return F.xxhash64(*[F.col(p) if isinstance(p, str) else p for p in parts]).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def collisions(rows: DataFrame, *natural: str) -> DataFrame:
    """Ids that several natural keys share."""
    return rows.select("id", *natural).distinct().groupBy("id").count().where("count > 1").select("id")


class Catalog(Mapping[str, DataFrame]):
    """Tables by name, with the declared columns, types and order: a column that is missing is null, a table that is not given empty."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | None = None):
        unknown = set(tables or ()) - set(SCHEMAS)
        if unknown:
            raise KeyError(f"no such tables: {sorted(unknown)}")
        self.spark, self.tables = spark, dict(tables or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(name)
        if name not in self.tables:
            return self.spark.createDataFrame([], schema(name))
        table = self.tables[name]
        held = set(table.columns)
        return table.select(*[(F.col(f.name) if f.name in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in _struct(name)])

    def __iter__(self) -> Iterator[str]:
        return iter(SCHEMAS)

    def __len__(self) -> int:
        return len(SCHEMAS)

    def save(self, path: str, mode: str = "append") -> None:
        """Each table that was given, below ``path``."""
        for name in self.tables:
            self[name].write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")

    def views(self) -> None:
        """Registers every table for SQL."""
        for name in self:
            self[name].createOrReplaceTempView(name)

    @classmethod
    def load(cls, spark: SparkSession, path: str, names: list[str] | None = None) -> Catalog:
        root = path.rstrip("/")
        return cls(spark, {n: spark.read.schema(schema(n)).parquet(f"{root}/{n}") for n in names or SCHEMAS})

    def without_files(self, gone: DataFrame) -> Catalog:
        """The catalog after the files of ``gone`` (id) and all that belongs to them went, edges with a lost end included."""
        left: dict[str, DataFrame] = {}

        def kept(name: str) -> DataFrame:
            if name not in left:
                table = self[name]
                if name in PARENTS:
                    parent, foreign = PARENTS[name]
                    lost = self[parent].join(kept(parent).select("id"), "id", "left_anti").select(F.col("id").alias(foreign))
                    table = table.join(lost, foreign, "left_anti")
                elif name == "files" or "file_id" in table.columns:
                    own = "id" if name == "files" else "file_id"
                    table = table.join(gone.select(F.col("id").alias(own)), own, "left_anti")
                left[name] = table.select(*self[name].columns)
            return left[name]

        for name in self.tables:
            if name != "relations":
                kept(name)
        if "relations" in self.tables:
            from ..operators.named import vertices

            edges = self["relations"]
            lost = vertices(self).join(vertices(Catalog(self.spark, left)).select("type", "id"), ["type", "id"], "left_anti").select("type", "id")
            for side in ("source", "target"):
                edges = edges.join(lost.select(F.col("type").alias(f"{side}_type"), F.col("id").alias(f"{side}_id")), [f"{side}_type", f"{side}_id"], "left_anti")
            left["relations"] = edges.select(*self["relations"].columns)
        return Catalog(self.spark, left)
