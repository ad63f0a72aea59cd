"""DuckDB SQL of the operators whose SQL is long, built from the operators' own fixed values."""

from __future__ import annotations

from . import pii


def _proposals(kind: str, pattern: str) -> str:
    """Matches of a pattern with their places: what lies between matches tells where they are."""
    return rf"""
{kind}_cut AS (
  SELECT r, text, unnest(string_split_regex(text, '{pattern}')) AS piece,
         unnest(list_append(regexp_extract_all(text, '{pattern}'), '')) AS found,
         unnest(range(len(regexp_extract_all(text, '{pattern}')) + 1)) AS i
  FROM rows WHERE regexp_matches(text, '{pattern}')),
{kind}_at AS (
  SELECT r, text, found, i, CAST(length(piece) + coalesce(sum(length(piece) + length(found)) OVER (
    PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
  FROM {kind}_cut),"""


def _near(kind: str) -> str:
    weight = (2 if kind in pii.UNCHECKED else 1) * pii.FOR
    good = pii.word_pattern(pii.WORDS_FOR[kind])
    bad = pii.word_pattern(pii.WORDS_AGAINST[kind]) if pii.WORDS_AGAINST[kind] else "[^\\s\\S]"
    return (f"{pii.SCORES[kind]} + CASE WHEN regexp_matches(near, '{good}') THEN {weight} ELSE 0 END"
            f" + CASE WHEN regexp_matches(near, '{bad}') THEN {pii.AGAINST} ELSE 0 END")


_DIGITS = "regexp_replace(found, '[^0-9]', '', 'g')"
_LUHN = """list_sum(list_transform(range(length(digits)), lambda i:
  CASE WHEN i % 2 = 0 THEN CAST(digits[length(digits) - i] AS INTEGER)
       ELSE CAST(digits[length(digits) - i] AS INTEGER) * 2
            - CASE WHEN CAST(digits[length(digits) - i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
_SHAPE = "([0-9]{3})-([0-9]{2})-([0-9]{4})"
_REST = """list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(
  substr(account, 5) || substr(account, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c
  ELSE CAST(ascii(c) - 55 AS VARCHAR) END), ''), ''), lambda c: CAST(c AS BIGINT)),
  lambda a, b: (a * 10 + b) % 97) = 1"""
_LENGTHS = ", ".join(f"('{k}', {v})" for k, v in pii.IBAN_LENGTHS.items())

OP13_SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lengths(country, size) AS (VALUES """ + _LENGTHS + r"""),""" + "".join([
    _proposals("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    _proposals("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    _proposals("card", r"[0-9](?:[\x20-]?[0-9])+"),
    _proposals("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    _proposals("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}"),
    _proposals("ssn", r"[0-9-]+"),
    _proposals("tel", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}")]) + rf"""
cards AS (SELECT *, {_DIGITS} AS digits FROM card_at WHERE length(found) >= 13),
ibans AS (
  SELECT r, text, s, array_to_string(string_split(found, ' '), '') AS bare, found, size
  FROM iban_at JOIN lengths ON country = substr(found, 1, 2)),
accounts AS (
  SELECT r, text, s, bare[1:size] AS account,
         regexp_extract(found, '^(?:\x20?[A-Z0-9]){{' || size || '}}') AS found
  FROM ibans WHERE length(bare) >= size),
spans AS (
  SELECT r, text, 1 AS k, 'email' AS kind, s, found FROM email_at WHERE found <> ''
  UNION ALL SELECT r, text, 2, 'ip', s, found FROM ip_at WHERE found <> '' AND list_bool_and(
    list_transform(string_split(found, '.'), lambda p: length(ltrim(p, '0')) <= 3
      AND CAST('0' || right(p, 3) AS INTEGER) <= 255))
  UNION ALL SELECT r, text, 3, 'card', s, found FROM cards
    WHERE length(digits) BETWEEN 13 AND 19 AND {_LUHN}
  UNION ALL SELECT r, text, 4, 'phone', s, found FROM phone_at
    WHERE length({_DIGITS}) BETWEEN 9 AND 15
  UNION ALL SELECT r, text, 5, 'iban', s, found FROM accounts
    WHERE NOT regexp_matches(text[s:s], '[A-Za-z0-9]') AND {_REST}
      AND NOT regexp_matches(text[s + length(found) + 1:s + length(found) + 1], '[A-Za-z0-9]')
  UNION ALL SELECT r, text, 6, 'ssn', s, found FROM ssn_at
    WHERE regexp_full_match(found, '{_SHAPE}') AND found[1:3] NOT IN ('000', '666')
      AND found[1:3] < '900' AND found[5:6] <> '00' AND found[8:11] <> '0000'
  UNION ALL SELECT r, text, 7, 'tel', s, found FROM tel_at WHERE found <> ''
    AND NOT regexp_matches(text[s:s], '[0-9+./(-]')
    AND NOT regexp_matches(text[s + length(found) + 1:s + length(found) + 1], '[0-9+./(-]')),
placed AS (
  SELECT *, s + length(found) AS e, lower(substr(text, greatest(1, s - {pii.BEFORE - 1}),
    least(s, {pii.BEFORE})) || chr(10) || substr(text, s + length(found) + 1, {pii.BEHIND})) AS near
  FROM spans),
scored AS (
  SELECT r, k, kind, s, e, CASE kind {" ".join(
      f"WHEN '{k}' THEN {_near(k)}" for k in pii.KINDS)} END AS score FROM placed),
kept AS (
  SELECT * FROM scored a WHERE k <= 4 OR (score >= 60 AND (k = 5 OR NOT EXISTS (
    SELECT 1 FROM scored b WHERE b.r = a.r AND b.k <= 4 AND b.s < a.e AND a.s < b.e)))),
told AS (
  SELECT r, count(*) FILTER (WHERE k = 1) AS n_email, count(*) FILTER (WHERE k = 2) AS n_ip,
         count(*) FILTER (WHERE k = 3) AS n_card, count(*) FILTER (WHERE k = 4) AS n_phone,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (WHERE k <= 4) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans
  FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip,
       coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM rows LEFT JOIN told USING (r)
"""


_OFF = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"


def _nearest(k: int) -> str:
    return f"""
near{k} AS (
  SELECT r, p, min({{'d': {_OFF}, 'e': e}}) AS best FROM parts JOIN book{k} USING (p) GROUP BY r, p),"""


def _renewed(k: int) -> str:
    return _nearest(k) + f"""
sums{k} AS (
  SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (
    SELECT p, best.e AS e, i, CAST(sum(x[i]) AS DOUBLE) AS s, count(*) AS n
    FROM near{k} JOIN parts USING (r, p), unnest(range(1, len(x) + 1)) AS u(i)
    GROUP BY p, best.e, i) GROUP BY p, e),
book{k + 1} AS (
  SELECT p, e, coalesce(s.c, b.c) AS c FROM book{k} b LEFT JOIN sums{k} s USING (p, e)),"""


OP11_SQL = """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
         list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(
    embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding)),
parts AS (
  SELECT r, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS x
  FROM kept, unnest(range(16)) AS u(p)),
book0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 64),""" + _renewed(0) + _renewed(1) + (
    _nearest(2)) + """
coded AS (
  SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code,
         CAST(sum(best.d) AS BIGINT) AS error FROM near2 GROUP BY r),
listed AS (
  SELECT string_agg(array_to_string(c, ','), ',' ORDER BY p, e) AS entries FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       sha256(entries) AS codebooks_sha256
FROM kept JOIN coded USING (r), listed
"""


_TERMS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
totals AS (
  SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs
  WHERE len(terms) > 0),
postings AS (
  SELECT r, doc_id, len(terms) AS n, term, count(*) AS tf
  FROM (SELECT r, doc_id, terms, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, totals GROUP BY term, n_docs),
asked AS (
  SELECT DISTINCT i, item_id, unnest(terms) AS term FROM (
    SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark)),
scored AS (
  SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (
    1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), totals GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
