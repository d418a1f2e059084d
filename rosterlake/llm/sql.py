"""SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from . import mixing, warc


def warc_sql(least_bytes: int = warc.LEAST_BYTES) -> str:
    return f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= {least_bytes} AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= {least_bytes} AND first < page_id THEN first END AS refers_to FROM f"""


def mixing_sql(
    topics: dict[str, tuple[str, ...]] = mixing.TOPICS,
    targets: dict[str, dict[str, float]] = mixing.TARGETS,
    temper: float = mixing.TEMPER,
    sweeps: int = mixing.SWEEPS,
    budget: float = mixing.BUDGET,
    rest: float = mixing.REST,
) -> str:
    """Every sweep over the dimensions is a step of its own."""
    counts = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words)}))) AS c{k}" for k, words in enumerate(topics.values()))
    top = f"greatest(1, {', '.join(f'c{k}' for k in range(len(topics)))})"
    topic = "CASE " + " ".join(f"WHEN c{k} = {top} THEN '{t}'" for k, t in enumerate(topics)) + f" ELSE '{mixing.OTHER}' END"
    steps, before = [], "cells"
    marks = mixing.MARKS.replace("'", "''")
    for d in mixing.DIMENSIONS:
        listed = targets.get(d, {})
        known = "CASE " + " ".join(f"WHEN {d} = '{v}' THEN {float(x)}" for v, x in listed.items()) + " END" if listed else "CAST(NULL AS DOUBLE)"
        left = max(rest, 1.0 - sum(listed.values()))
        steps.append(f"n_{d} AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY {d}) AS DOUBLE) AS n, {known} AS known FROM {before})")
        steps.append(f"f_{d} AS (SELECT *, tokens / n AS part, power(n, {temper}) AS free FROM n_{d})")
        steps.append(f"s_{d} AS (SELECT *, coalesce(known, {left} * free / sum(CASE WHEN known IS NULL THEN part * free END) OVER ()) AS s FROM f_{d})")
        steps.append(f"t_{d}s AS (SELECT * EXCLUDE (n, known, part, free, s), coalesce(s / nullif(sum(part * s) OVER (), 0), 0) * sum(tokens) OVER () * {budget} AS t_{d} FROM s_{d})")
        before = f"t_{d}s"
    steps.append(f"w AS (SELECT *, CAST(tokens AS DOUBLE) AS weight FROM {before})")
    before = "w"
    for k in range(sweeps):
        for d in mixing.DIMENSIONS:
            name = f"s{k}_{d}"
            steps.append(f"{name} AS (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {d}) > 0 THEN weight / sum(weight) OVER (PARTITION BY {d}) * t_{d} ELSE 0 END AS weight) FROM {before})")
            before = name
        steps.append(f"s{k} AS (SELECT * REPLACE (least(weight, CAST(tokens AS DOUBLE)) AS weight) FROM {before})")
        before = f"s{k}"
    return f"""WITH docs AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS x FROM documents),
spaced AS (SELECT *, string_split(translate(lower(x), '{marks}', '{" " * len(mixing.MARKS)}'), ' ') AS w FROM docs),
counted AS (SELECT *, greatest(length(regexp_replace(regexp_replace(x, '[^ \t\n\r]+', 'x', 'g'), '[ \t\n\r]+', '', 'g')), 1) AS tokens, {counts} FROM spaced),
rows AS (SELECT doc_id, x, source, lang, {topic} AS topic, tokens FROM counted),
cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM rows GROUP BY 1, 2, 3),
{", ".join(steps)},
p AS (SELECT source, lang, topic, round(weight / tokens, 9) AS probability FROM {before} WHERE weight > 0)
SELECT doc_id, source, lang, topic, tokens, probability FROM rows JOIN p USING (source, lang, topic)
WHERE CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || x)), 12) AS BIGINT) / {float(1 << 48)} < probability"""


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": mixing_sql(), "op8_warc": warc_sql()}
