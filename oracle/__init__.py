"""DuckDB twins of the registered queries, used only for checking."""

from oracle.pages import PAGE_SQL
from oracle.records import RECORD_SQL


def all_sql() -> dict[str, str]:
    return {**PAGE_SQL, **RECORD_SQL}
