"""Entity spans in SQL: every rule as a relation of places, overlaps decided by comparing spans.

Patterns, lengths and scores are spelled out here again, so that a wrong constant on either side shows."""

_RULES = [
    ("EMAIL_ADDRESS", 1.0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("US_SSN", 0.85, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("PHONE_NUMBER", 0.75, r"\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\b"),
    ("IP_ADDRESS", 0.95, r"\b(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
                         r"(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}\b"),
    ("(digits)", 0, r"[0-9]+(?:[ -][0-9]+)*"),
    ("(iban)", 0, r"\b[A-Z]{2}[0-9]{2}"),
]

_LUHN = """list_sum(list_transform(list_reverse(string_split(digits, '')), lambda d, i: CASE WHEN i % 2 = 0
        THEN (d::INT * 2) // 10 + (d::INT * 2) % 10 ELSE d::INT END)) % 10 = 0"""
_MOD_97 = """list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(value, 5) || substr(value, 1, 4), ''),
        lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN (ascii(c) - 48)::BIGINT ELSE (ascii(c) - 55)::BIGINT END)),
        lambda a, c: (a * CASE WHEN c < 10 THEN 10 ELSE 100 END + c) % 97) = 1"""


def _total(pieces):
    return f"coalesce(list_sum(list_transform({pieces}, lambda x: length(x))), 0)::BIGINT"


def visible_spans(source, key, column, more=()):
    """SELECT of (k, s, e, kind): the places of all entities that no better ones cover, [s, e) from 0.

    ``more`` has (kind, score, pattern) of further rules."""
    texts = "\n      UNION ALL ".join(
        f"SELECT k, t, '{kind}' AS kind, {score}::DOUBLE AS score, regexp_extract_all(t, '{pattern}') AS m, "
        f"regexp_split_to_array(t, '{pattern}') AS g FROM src"
        for kind, score, pattern in [*_RULES, *more]
    )
    return f"""
      WITH src AS (SELECT {key} AS k, coalesce({column}, '') AS t FROM {source}),
      matched AS ({texts}),
      placed AS (SELECT k, t, kind, score, m[i] AS v, {_total('g[1:i]')} + {_total('m[1:i - 1]')} AS s
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM matched WHERE len(m) > 0)),
      runs AS (SELECT k, t, s, string_split(replace(v, '-', ' '), ' ') AS w FROM placed
        WHERE kind = '(digits)' AND length(v) >= 13),
      windows AS (SELECT k, t, s + {_total('w[1:i - 1]')} + i - 1 AS s, array_to_string(w[i:j], '') AS digits,
          [{_total('w[i:x]')} FOR x IN range(i, j)] AS breaks, j - i AS blanks
        FROM (SELECT *, unnest(range(i, least(i + 5, len(w) + 1))) AS j FROM
          (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM runs)) WHERE length(w[i]) <= 19),
      cards AS (SELECT k, t, s, s + length(digits) + blanks AS e FROM windows
        WHERE length(digits) BETWEEN 13 AND 19 AND digits[1] BETWEEN '1' AND '6' AND NOT (length(digits) = 13 AND digits[1] = '1')
          AND (len([b FOR b IN breaks IF b % 4 <> 0]) = 0 OR len([b FOR b IN breaks IF b <> 4 AND b <> 10]) = 0) AND {_LUHN}),
      heads AS (SELECT k, t, s, string_split(regexp_extract(substr(t, s + 1, 60), '^[A-Z0-9]+(?: [A-Z0-9]+)*'), ' ') AS w
        FROM placed WHERE kind = '(iban)'),
      values_ AS (SELECT k, t, s, array_to_string(w[1:j], '') AS value, j - 1 AS blanks,
          len([x FOR x IN range(1, j) IF {_total('w[1:x]')} % 4 <> 0]) AS uneven
        FROM (SELECT *, unnest(range(1, len(w) + 1)) AS j FROM heads)),
      ibans AS (SELECT k, t, s, s + length(value) + blanks AS e FROM values_
        WHERE uneven = 0 AND length(value) BETWEEN 15 AND 34 AND {_MOD_97}),
      whole AS (SELECT k, s, e, 'CREDIT_CARD' AS kind FROM cards
          WHERE NOT regexp_matches(substr(t, s::BIGINT, 1), '[A-Za-z0-9_]') AND NOT regexp_matches(substr(t, e::BIGINT + 1, 1), '[A-Za-z0-9_]')
        UNION ALL SELECT k, s, e, 'IBAN_CODE' FROM ibans WHERE NOT regexp_matches(substr(t, e::BIGINT + 1, 1), '[A-Za-z0-9_]')),
      spans AS (SELECT DISTINCT * FROM (SELECT k, s, s + length(v) AS e, kind, score FROM placed WHERE kind[1] <> '('
        UNION ALL SELECT k, s, e, kind, 1.0 FROM whole)),
      ordered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY e - s DESC, score DESC, kind, s) AS place FROM spans),
      cut AS (SELECT x.k, x.kind, greatest(x.s, max(CASE WHEN b.s <= x.s THEN b.e END)) AS s,
          least(x.e, min(CASE WHEN b.s > x.s THEN b.s END)) AS e
        FROM ordered x LEFT JOIN ordered b ON b.k = x.k AND b.place < x.place AND b.s < x.e AND b.e > x.s
        GROUP BY x.k, x.kind, x.s, x.e, x.place)
      SELECT k, s, e, kind FROM cut WHERE s < e"""


def masked(source, key, column, spans):
    """SELECT of (k, masked): the texts of the source with the spans of a relation (k, s, e, kind) replaced."""
    return f"""
      SELECT {key} AS k, CASE WHEN {column} IS NULL THEN NULL ELSE coalesce(string_agg(part, '' ORDER BY s), '') || any_value(rest) END AS masked
      FROM (SELECT {key}, {column}, s, substr({column}, coalesce(lag(e) OVER w, 0) + 1, s - coalesce(lag(e) OVER w, 0)) || '<' || kind || '>' AS part,
          substr({column}, coalesce(max(e) OVER (PARTITION BY {key}), 0) + 1) AS rest
        FROM {source} LEFT JOIN {spans} ON k = {key} WINDOW w AS (PARTITION BY {key} ORDER BY s))
      GROUP BY {key}, {column}"""
