"""The training-data queries that SQL can express, for an independent engine."""

from __future__ import annotations

from areashare.llm.mixing import ROUNDS, SEED, SHORT, TEMPERATURES, TOPICS

OP1 = r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER best AS kept,
       text_sha256
FROM keyed
WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)"""


def _mixing() -> str:
    """The raking rounds as one view after the other, then the level from which on cells stay whole.

    What cells above a level lack is the greatest sum of tokens * (weight - level) over any of them, and that over the
    cells from some weight on; so the level sought is the greatest that one of these asks for.
    """
    topic = " ".join(f"WHEN regexp_matches(text, '{pattern}') THEN '{name}'" for name, pattern in TOPICS)
    names = ", ".join(TEMPERATURES)
    marked = rf"""
marked AS (
  SELECT *, CASE {topic} ELSE 'prose' END AS topic,
         greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS tokens
  FROM documents),
cells AS (SELECT {names}, sum(tokens)::BIGINT AS tokens FROM marked GROUP BY ALL)"""
    views = [marked]
    for name, power in TEMPERATURES.items():
        views.append(
            f"t_{name} AS (SELECT {name} AS v_{name}, p / sum(p) OVER () AS target_{name} FROM"
            f" (SELECT {name}, pow(sum(tokens)::DOUBLE, {power}) AS p FROM cells GROUP BY ALL))"
        )
    joins = " ".join(f"JOIN t_{name} ON {name} IS NOT DISTINCT FROM v_{name}" for name in TEMPERATURES)
    views.append(f"r0 AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS weight FROM cells {joins})")
    steps = [name for _ in range(ROUNDS) for name in TEMPERATURES]
    for i, name in enumerate(steps):
        views.append(
            f"r{i + 1} AS MATERIALIZED (SELECT * REPLACE (weight * target_{name}"
            f" / sum(tokens * weight) OVER (PARTITION BY {name}) AS weight) FROM r{i})"
        )
    last = f"r{len(steps)}"
    same = " AND ".join(f"m.{name} IS NOT DISTINCT FROM c.{name}" for name in TEMPERATURES)
    return f"""
WITH {", ".join(views)},
heaviest AS (SELECT sum(tokens * weight) OVER w AS asked, sum(tokens) OVER w AS held, sum(tokens * weight) OVER () AS total
             FROM {last} WINDOW w AS (ORDER BY weight DESC ROWS UNBOUNDED PRECEDING)),
top AS (SELECT max((asked - {SHORT} * total) / held) AS level FROM heaviest),
shares AS (SELECT m.doc_id, m.topic, m.tokens::BIGINT AS tokens,
                  least(1, round(c.weight / (SELECT level FROM top), 9)) AS p
           FROM marked m JOIN {last} c ON {same})
SELECT doc_id, topic, tokens, round(p, 6) AS probability,
       ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < p
       AS sampled
FROM shares"""


OP12 = r"""
WITH marks AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
base AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
flagged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))
                 > 10 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM base LEFT JOIN marks USING (doc_id)),
counts AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM flagged GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)),
states AS (
  SELECT *, translate(fails, before, '') = fails AS there, contains(fails, own) AS failed FROM counts, steps),
audit AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (there AND NOT failed), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (there AND failed), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (failed AND NOT there), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (there AND failed), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (there AND failed), 0)::BIGINT AS toxic_lost
  FROM states GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM audit"""

ORACLE_SQL = {"op1_exact_dedup": OP1, "op9_mixing": _mixing(), "op12_filter_audit": OP12}
