"""Whether a command's output tells of failure, for logs without an error flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.text import is_kind, trim_space, value_at, variant

# Fixed value: how outputs state an exit code.
EXIT_CODE = r"(?idm)^(?:Process exited with code|Exit code:)[\t\n\f\r ]*([0-9]+)[\t\n\f\r ]*$"


def command_output_failed(output: Column) -> Column:
    """By a JSON envelope's exit code or timeout; else by the first line; else by the text before the output proper."""
    text = trim_space(output)
    v = variant(text)
    code, inner = (F.when(is_kind(value_at(v, p), "NUMBER"), F.try_variant_get(v, p, "double")) for p in ("$.exit_code", "$.metadata.exit_code"))
    timed_out = F.coalesce(F.try_variant_get(v, "$.timed_out", "boolean"), F.lit(False))
    object_ = is_kind(v, "OBJECT")
    first = F.lower(trim_space(F.substring_index(text, "\n", 1)))
    header = F.substring_index(F.substring_index(text, "\nOutput:\n", 1), "\nFinal output:\n", 1)
    aborted = F.exists(F.split(header, "\n"), lambda line: F.lower(trim_space(line)) == "aborted by user")
    status = F.regexp_extract(header, EXIT_CODE, 1)
    starts = lambda c, p: F.startswith(c, F.lit(p))
    return (
        F.when(object_ & code.isNotNull(), code != 0).when(object_ & inner.isNotNull(), inner != 0).when(object_ & timed_out, True)
        .when(starts(F.lower(text), "apply_patch verification failed"), True)
        .when(starts(first, "script completed") | starts(first, "script running"), False).when(starts(first, "script failed"), True)
        .when(aborted, True).otherwise((status != "") & (status != "0"))
    )
