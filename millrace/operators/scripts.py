"""Rows through external commands: TRANSFORM, MAP and REDUCE."""

from __future__ import annotations

import base64
import shlex

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.scratch import new_name

MAX_FILE_BYTES = 64 * 1024


def sql_text(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def shell_command(
    command: str,
    env: dict[str, str] | None = None,
    files: dict[str, str] | None = None,
    allow_partial: bool = False,
) -> str:
    """The line an executor runs.

    ``env`` becomes environment variables. ``files`` (name to text) are unpacked
    into a fresh folder on the executor, whose path is ``$SCRIPT_DIR``. With
    ``allow_partial`` the command may stop reading early; what is left is drained.
    """
    parts = [f"export {k}={shlex.quote(v)}" for k, v in (env or {}).items()]
    if files:
        parts.append('export SCRIPT_DIR="$(mktemp -d)"; trap \'rm -r "$SCRIPT_DIR"\' EXIT')
        for name, text in files.items():
            if len(text) > MAX_FILE_BYTES:
                raise ValueError(f"{name} is too large to send with the command")
            packed = base64.b64encode(text.encode()).decode()
            parts.append(f'echo {packed} | base64 -d > "$SCRIPT_DIR"/{shlex.quote(name)}')
    parts.append(f"{{ {command}; }}" if not allow_partial else f"{{ {{ {command}; }}; cat > /dev/null; }}")
    return "; ".join(parts)


def transform(df: DataFrame, command: str, schema: str, **how) -> DataFrame:
    """``SELECT TRANSFORM (*) USING command AS (schema)``.

    Rows go to the command's standard input as tab-separated text with ``\\N``
    for NULL, partition by partition; its output lines become rows, cast to
    ``schema``. Values must not hold tabs or line breaks. A failing command
    fails the task.
    """
    fields = T.StructType.fromDDL(schema).fields
    given = ", ".join(f"`{c}`" for c in df.columns)
    taken = ", ".join(f"`{f.name}` STRING" for f in fields)
    row_format = "ROW FORMAT DELIMITED FIELDS TERMINATED BY '\\t' LINES TERMINATED BY '\\n' NULL DEFINED AS '\\\\N'"
    view = new_name("script_rows")
    df.createOrReplaceTempView(view)
    text = df.sparkSession.sql(
        f"SELECT TRANSFORM ({given}) {row_format} USING {sql_text(shell_command(command, **how))} "
        f"AS ({taken}) {row_format} FROM {view}"
    )
    df.sparkSession.catalog.dropTempView(view)
    return text.select(*[text[f.name].try_cast(f.dataType).alias(f.name) for f in fields])
