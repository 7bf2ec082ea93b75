"""Names and terms in comparison form, as DuckDB SQL for the twins."""


def sql_key(c: str) -> str:
    """SQL of :func:`skirmish.functions.names.name_key`."""
    k = f"lower(regexp_replace(trim(regexp_replace({c}, ' +', ' ', 'g')), '[\'\'`]s corpse$', '', 'i'))"
    return f"(case when {k} not like '% %' and length({k}) > 8 and {k} like '%scorpse' then left({k}, length({k}) - 7) else {k} end)"


def sql_term(c: str) -> str:
    """SQL of :func:`skirmish.functions.names.term_key`."""
    return f"nullif(lower(trim(regexp_replace({c}, ' +', ' ', 'g'))), '')"
