"""DuckDB SQL for the queries that SQL can express."""

#: The words of a text, A-Z in lower case, as `WORD` splits them.
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _shingles(table: str, key: str, row: str, lengths: str) -> str:
    """Distinct shingles of each row of a table: runs of n words, for each n that lengths selects."""
    return f"""
        SELECT DISTINCT {row}, {key}, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS shingle
        FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k
              FROM (SELECT row_number() OVER () AS {row}, {key}, {_WORDS} AS w FROM {table} WHERE text IS NOT NULL), {lengths}
              WHERE len(w) >= n AND n > 0)"""


def _host(url: str) -> str:
    return f"coalesce(translate(regexp_extract({url}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"


def _node(url: str) -> str:
    query = f"regexp_extract({url}, '^.*?://[^?#]*[?]([^#]*)', 1, 's')"
    kept = f"array_to_string(list_filter(string_split({query}, '&'), lambda x: x <> '' AND NOT regexp_full_match(x, '(utm_[a-z]+|gclid|fbclid|ref)(=.*)?', 's')), '&')"
    return f"CASE WHEN contains({url}, '://') THEN {_host(url)} || regexp_replace({_path(url)}, '/+$', '') || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END"


_RULES = "(VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')) AS r(verdict, h, p)"
_LINK = r"""concat(regexp_extract(tag, '\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'i'))"""


ORACLE_SQL: dict[str, str] = {
    "op10_decontaminate": f"""
        WITH i AS ({_shingles("benchmark", "item_id", "i_row", "LATERAL (SELECT least(len(w), 5) AS n)")}),
             d AS ({_shingles("documents", "doc_id", "d_row", "(SELECT DISTINCT n FROM i)")}),
             sizes AS (SELECT i_row, count(*) AS item_shingles FROM i GROUP BY i_row),
             hits AS (SELECT d_row, doc_id, i_row, item_id, count(*) AS shared
                      FROM i JOIN d USING (shingle, n) GROUP BY ALL)
        SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
        FROM hits JOIN sizes USING (i_row)
        WHERE shared >= 0.8 * item_shingles - 1e-9""",
    # absolute canonical links; the fixture tests cover the other kinds of edges
    "op7_url_aliases": f"""
        WITH RECURSIVE own AS (
            SELECT row_number() OVER () AS n, page_id, {_host("url")} AS host, {_path("url")} AS path, {_node("url")} AS node,
                   list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '<link\\b[^>]*>', 0, 'i'), lambda t: regexp_matches(t, 'rel\\s*=\\s*["'']?canonical', 'i')), lambda tag: {_LINK}) AS targets
            FROM pages),
        links AS (SELECT node, target, {_node("target")} AS to_node FROM (SELECT node, unnest(targets) AS target FROM own) WHERE contains(target, '://')),
        named AS (SELECT n, host, path, node FROM own UNION ALL SELECT -row_number() OVER (), {_host("target")}, {_path("target")}, to_node FROM links),
        judged AS (SELECT named.n, node, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS ruled
                   FROM named JOIN {_RULES} ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY ALL),
        edges AS (SELECT node AS u, to_node AS v FROM links UNION SELECT to_node, node FROM links),
        reach AS (SELECT DISTINCT node AS a, node AS b FROM named WHERE node IS NOT NULL
                  UNION SELECT a, v FROM reach JOIN edges ON b = u),
        marked AS (SELECT a AS node, bool_or(ruled = 'allow') AS allow, bool_or(ruled = 'block') AS block FROM reach JOIN judged ON b = judged.node GROUP BY a)
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN block AND NOT allow THEN 'block' ELSE 'allow' END) AS verdict
        FROM own LEFT JOIN judged USING (n) LEFT JOIN marked ON own.node = marked.node""",
}
