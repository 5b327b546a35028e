"""Functions that SQL can call: scalar and table functions defined in SQL, registered in a session.

Their bodies are plain expressions, so Catalyst inlines them into the query that calls them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from estimark.sources.xml import TASKS_SCHEMA

_TASKS = f"from_xml(tasks_xml, '{TASKS_SCHEMA}', map('rowTag', 'tasks'))"
_MINUTES = "try_cast(t.`_time-discussion` AS INT)"

FUNCTIONS = {
    # a list is refused if it does not parse, or one task has no name, no minutes, or minutes of 0 or outside 0..10
    "is_null_or_empty": f"""(tasks_xml STRING) RETURNS BOOLEAN
RETURN coalesce({_TASKS}._corrupt_record, '') <> '' OR {_TASKS} IS NULL
  OR exists(coalesce({_TASKS}.task, array()), t -> t._name IS NULL OR rtrim(t._name) = '' OR {_MINUTES} IS NULL
    OR {_MINUTES} = 0 OR {_MINUTES} NOT BETWEEN 0 AND 10)""",
    "same_key": "(a STRING, b STRING) RETURNS BOOLEAN RETURN a COLLATE UTF8_LCASE_RTRIM = b COLLATE UTF8_LCASE_RTRIM",
    "room_tasks": f"""(tasks_xml STRING) RETURNS TABLE (pos INT, name STRING, minutes INT)
RETURN SELECT pos, t._name, {_MINUTES} FROM (SELECT posexplode({_TASKS}.task) AS (pos, t))""",
}


def register_functions(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL (again, if they are already)."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
