"""DuckDB SQL of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

import re

from .licenses import LICENSES as WHOLE

POISSON = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
    SELECT source, (SELECT sum(n) FROM n) / (SELECT sum(sqrt(n)) FROM n) * sqrt(n) / n AS rate FROM n),
cdf AS (
    SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
    FROM rates, range(0, 200) AS r(k)),
drawn AS (
    SELECT doc_id, source, ('0x' || substr(md5('20240131:' || doc_id || ':0'), 1, 13))::BIGINT / pow(2, 52) AS u
    FROM documents),
counted AS (
    SELECT doc_id, d.source, any_value(rate) AS rate, count(*) AS n_copies
    FROM drawn d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source AND c <= u GROUP BY doc_id, d.source)
SELECT doc_id, source, round(rate, 9) AS rate, n_copies::INTEGER AS n_copies, copy::INTEGER AS copy,
    substr(md5('20240132:' || doc_id || ':' || copy), 1, 16) AS shuffle_key
FROM (SELECT *, unnest(range(0, n_copies)) AS copy FROM counted)
"""

# Words joined by single spaces; templates as patterns over them.
LICENSES = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
p AS (
    SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS line,
        list_filter(range(len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS mit,
        list_filter(range(len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS apache,
        list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS gpl
    FROM w),
l AS (
    SELECT doc_id, n_words, list_concat(list_concat(mit, apache), gpl) AS places,
        list_filter([
            CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END,
            CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL) AS base,
        list_filter([
            /* whole texts */
            CASE WHEN regexp_matches(line, ' licensed under the (terms of the )?apache license (version )?2 0 ') THEN 'apache-2.0-notice' END,
            CASE WHEN regexp_matches(line, ' redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met ') THEN 'bsd-conditions' END,
            CASE WHEN regexp_matches(line, ' licensed under (the )?cc by nc [0-9]+ ') THEN 'cc-by-nc-notice' END,
            CASE WHEN regexp_matches(line, ' licensed under the (terms of the )?gnu general public license ') THEN 'gpl-notice' END,
            CASE WHEN regexp_matches(line, ' (released|licensed|distributed|available) under the (terms of the )?mit license ') THEN 'mit-notice' END,
            CASE WHEN regexp_matches(line, ' permission is hereby granted free of charge to any person obtaining a copy of this ([^ ]+ ){1,3}(and associated documentation files )?(the [^ ]+ )?to deal in the [^ ]+ without restriction ') THEN 'mit-permission' END
        ], lambda x: x IS NOT NULL) AS more
    FROM p)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
    array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_concat(base, more)), ',') AS labels,
    CASE WHEN len(more) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM l
"""


# Failed filters as bits; E by the smallest id of a text.
AUDIT = r"""
WITH t AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
    SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS failed
    FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (
    SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
    FROM f LEFT JOIN l USING (doc_id) GROUP BY part, failed),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
    SELECT filter_order, step::INTEGER AS step, bits[step] AS own, coalesce(list_sum(bits[:step - 1]), 0)::INTEGER AS before
    FROM orders, range(1, 6) AS r(step)),
sums AS (
    SELECT part, filter_order, step, own,
        coalesce(sum(n) FILTER (WHERE failed & (before | own) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (WHERE failed & own > 0 AND failed & before = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (WHERE failed & own > 0 AND failed & before > 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (WHERE failed = own), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (WHERE failed & own > 0 AND failed & before = 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (WHERE failed & own > 0 AND failed & before = 0), 0)::BIGINT AS toxic_lost
    FROM c, steps GROUP BY part, filter_order, step, own)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM sums
"""

EXACT = """
WITH t AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


def template_pattern(markup: str) -> str:
    """A template as a pattern over words that are each followed by one space."""
    out = []
    for k, piece in enumerate(re.split(r"<<(.*?)>>", markup)):
        if k % 2 == 0:
            out += [f"{word} " for word in re.findall("[0-9a-z]+", piece.lower())]
        elif piece.startswith("var;"):
            options = dict(re.findall(r'(words|match)="?([^;"]+)', piece))
            low, _, high = options.get("words", "1").partition("-")
            out.append(f"((?:{options.get('match', '[^ ]+')}) ){{{low},{high or low}}}")
        else:
            out.append("(" if piece == "beginOptional" else ")?")
    return "".join(out)


def _license_cases() -> str:
    return "\n            ".join(
        f"CASE WHEN regexp_matches(line, ' {template_pattern(markup)}') THEN '{label}' END," for label, markup in WHOLE.items())


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_templates": LICENSES.replace("/* whole texts */", _license_cases()), "op8_poisson_mix": POISSON, "op11_filter_audit": AUDIT, "op12_digest_index": EXACT,
    }
