"""The extractors, hashes and lookups under names that SQL can call.

``select path, x.* from files lateral view inline(sql_rows(text)) x`` gives the
rows of every file; a null or empty text gives none."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import extract, forms, jobs, sqltext, units

#: Name in SQL: what reads a text, and the rows it gives.
EXTRACTORS = {
    "sql_rows": (sqltext.sql_rows, sqltext.SQL), "pas_rows": (units.unit_rows, units.UNIT), "header_rows": (extract.header_rows, extract.HEADER), "script_rows": (extract.script_rows, extract.SCRIPT),
    "game_rows": (extract.game_rows, extract.GAME), "form_rows": (forms.form_rows, forms.FORM), "sectioned_report_rows": (forms.sectioned_report_rows, forms.REPORT), "object_report_rows": (forms.object_report_rows, forms.REPORT),
    "job_rows": (jobs.job_rows, jobs.JOB), "library_rows": (jobs.library_rows, jobs.JOB), "sql_table_rows": (forms.sql_tables, forms.TABLE),
}


def register(spark: SparkSession) -> list[str]:
    """Registers every extractor in the session; their names."""
    for name, (parse, row) in EXTRACTORS.items():
        spark.udf.register(name, extract.rows_function(parse, row))
    return list(EXTRACTORS)
