"""SQL statement of the resolver: every pair of offers, then joining along smallest edges."""

from __future__ import annotations

from shelfscope.plans.oracle_parts import PARTS, RECURSIVE, own_key, part, rounded

LCS = """list_reduce(list_transform(string_split({a}, ''), lambda c: [CAST(ascii(c) AS INTEGER)]),
  lambda acc, ch: list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [CAST(j AS INTEGER)]),
    lambda r, j: list_append(r, greatest(r[j[1]], acc[j[1] + 1],
      CASE WHEN ascii(substring({b}, j[1], 1)) = ch[1] THEN acc[j[1]] + 1 ELSE 0 END)), [CAST(0 AS INTEGER)]),
  list_transform(range(0, length({b}) + 1), lambda z: CAST(0 AS INTEGER)))[-1]"""

part(
    "labelled",
    """
    SELECT o.*, coalesce(nullif(o.gtin_norm, ''), w.owner) IS NOT NULL AS rooted,
      coalesce('g:' || coalesce(nullif(o.gtin_norm, ''), w.owner), 'k:' || o.structural_key, 'o:' || CAST(o.offer_ord AS VARCHAR)) AS label0,
      o.brand_slug || '|' || coalesce(CAST(o.volume_ml_canon AS VARCHAR), '') || '|' || CAST(o.pack_qty AS VARCHAR) AS block,
      array_to_string(list_sort(list_distinct(string_split(o.nombre_norm, ' '))), ' ') AS words
    FROM offers o LEFT JOIN (SELECT structural_key, gtin_norm AS owner FROM (SELECT structural_key, gtin_norm,
        row_number() OVER (PARTITION BY structural_key ORDER BY offer_ord) AS rn
      FROM offers WHERE gtin_norm <> '' AND structural_key IS NOT NULL) WHERE rn = 1) w ON w.structural_key = o.structural_key""",
    ["offers"],
)
part(
    "word_pairs",
    """
    SELECT block, words_a, words_b, shared, array_to_string(list_sort(list_filter(la, lambda x: NOT list_contains(lb, x))), ' ') AS a,
      array_to_string(list_sort(list_filter(lb, lambda x: NOT list_contains(la, x))), ' ') AS b
    FROM (SELECT *, length(array_to_string(list_filter(la, lambda x: list_contains(lb, x)), ' ')) AS shared
      FROM (SELECT l.block, l.words AS words_a, r.words AS words_b, string_split(l.words, ' ') AS la, string_split(r.words, ' ') AS lb
        FROM (SELECT DISTINCT block, words FROM labelled WHERE words <> '') l
        JOIN (SELECT DISTINCT block, words FROM labelled WHERE words <> '') r ON r.block = l.block AND r.words > l.words))""",
    ["labelled"],
)
part(
    "scored",
    f"""
    SELECT block, words_a, words_b, CASE WHEN shared > 0 AND (a = '' OR b = '') THEN CAST(100 AS DOUBLE)
        ELSE greatest(sides, CASE WHEN ceiling >= 90 AND sides < 90 THEN
          100.0::DOUBLE - 100.0::DOUBLE * (length(a) + length(b) - 2 * {LCS.format(a='a', b='b')}) / (wa + wb) ELSE CAST(0 AS DOUBLE) END) END AS score
    FROM (SELECT *, CASE WHEN shared > 0 THEN greatest(100.0::DOUBLE - 100.0::DOUBLE * (gap + length(a)) / (shared + wa),
          100.0::DOUBLE - 100.0::DOUBLE * (gap + length(b)) / (shared + wb)) ELSE CAST(0 AS DOUBLE) END AS sides,
        100.0::DOUBLE - 100.0::DOUBLE * abs(length(a) - length(b)) / (wa + wb) AS ceiling
      FROM (SELECT *, shared + gap + length(a) AS wa, shared + gap + length(b) AS wb
        FROM (SELECT *, CASE WHEN shared > 0 THEN 1 ELSE 0 END AS gap FROM word_pairs)))""",
    ["word_pairs"],
)
part(
    "similar_words",
    """
    SELECT block, words_a, words_b FROM scored WHERE score >= 90
    UNION ALL SELECT block, words_b, words_a FROM scored WHERE score >= 90
    UNION ALL SELECT DISTINCT block, words, words FROM labelled WHERE words <> ''""",
    ["scored"],
)
part(
    "edges",
    """
    SELECT least(x.label0, y.label0) AS a, greatest(x.label0, y.label0) AS b,
      min({'s': s.start, 'i': least(x.offer_ord, y.offer_ord), 'j': greatest(x.offer_ord, y.offer_ord)}) AS rank
    FROM labelled x JOIN similar_words m ON m.block = x.block AND m.words_a = x.words
      JOIN labelled y ON y.block = m.block AND y.words = m.words_b
      JOIN (SELECT block, min(offer_ord) AS start FROM labelled GROUP BY block) s ON s.block = x.block
    WHERE NOT x.rooted AND x.platform <> y.platform AND x.is_zero = y.is_zero AND x.label0 <> y.label0
      AND (x.variant_slug = y.variant_slug OR x.variant_slug = 'unknown' OR y.variant_slug = 'unknown')
    GROUP BY 1, 2""",
    ["labelled", "similar_words"],
)
part(
    "nodes",
    """
    SELECT DISTINCT l.label0 AS node, l.rooted FROM labelled l
    WHERE l.label0 IN (SELECT a FROM edges UNION SELECT b FROM edges)""",
    ["labelled", "edges"],
)
part(
    "rounds",
    """
    SELECT 0 AS round, node, node AS comp, rooted FROM nodes
    UNION ALL
    (WITH live AS (
        SELECT p.comp AS ca, p.rooted AS ra, q.comp AS cb, q.rooted AS rb, e.rank
        FROM edges e JOIN rounds p ON p.node = e.a JOIN rounds q ON q.node = e.b
        WHERE p.comp <> q.comp AND NOT (p.rooted AND q.rooted)),
      ends AS (SELECT ca AS c, cb AS o, rb AS ro, rank FROM live WHERE NOT ra
        UNION ALL SELECT cb, ca, ra, rank FROM live WHERE NOT rb),
      best AS (SELECT c, arg_min(o, rank) AS o, arg_min(ro, rank) AS ro FROM ends GROUP BY c),
      merges AS (SELECT x.c, CASE WHEN x.ro THEN x.o ELSE least(x.c, x.o) END AS goes, x.ro AS rooted
        FROM best x LEFT JOIN best y ON y.c = x.o WHERE x.ro OR y.o = x.c)
      SELECT r.round + 1, r.node, coalesce(m.goes, r.comp), r.rooted OR coalesce(m.rooted, FALSE)
      FROM rounds r LEFT JOIN merges m ON m.c = r.comp WHERE EXISTS (SELECT 1 FROM merges))""",
    ["nodes", "edges"],
)
RECURSIVE.add("rounds")
part(
    "resolved",
    """
    SELECT l.*, coalesce(f.comp, l.label0) AS label FROM labelled l LEFT JOIN
      (SELECT node, comp FROM rounds WHERE round = (SELECT max(round) FROM rounds)) f ON f.node = l.label0""",
    ["labelled", "rounds"],
)
part("resolved_exact", "SELECT l.*, label0 AS label FROM labelled l", ["labelled"])

VOTE = """(SELECT label, v AS {name} FROM (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY n DESC, v) AS rn
  FROM (SELECT label, {value} AS v, count(*) AS n FROM {source} GROUP BY 1, 2) WHERE v IS NOT NULL) WHERE rn = 1)"""


def canonical_parts(source: str, suffix: str = "") -> None:
    """Products and offers with their product, from a labelled source."""

    def vote(name: str, value: str) -> str:
        return VOTE.format(name=name, value=value, source=source)

    key = own_key(
        {
            "brand": "r.brand_slug",
            "sub": "q.sub_brand",
            "variant": "q.variant_slug",
            "volume": "r.volume_ml_canon",
            "container": "q.container",
            "pack": "r.pack_qty",
            "zero": "q.is_zero",
        }
    )
    title = """array_to_string(list_transform(string_split(replace(q.variant_slug, '-', ' '), ' '),
        lambda w: upper(w[1]) || w[2:]), ' ')"""
    part(
        f"canonicals{suffix}",
        f"""
    SELECT q.*, {key} AS canonical_key, r.brand_slug, r.brand_display, r.volume_ml_canon AS volume_ml, r.pack_qty,
      concat_ws(' ', r.brand_display, nullif(q.sub_brand, ''), CASE WHEN q.variant_slug <> 'unknown' THEN {title} END,
        CASE WHEN coalesce(r.volume_ml_canon, 0) <> 0 THEN CAST(r.volume_ml_canon AS VARCHAR) || 'ml' END, q.container,
        CASE WHEN r.pack_qty > 1 THEN 'x' || CAST(r.pack_qty AS VARCHAR) END) AS display_name,
      CASE WHEN n_platforms < 2 THEN 'single' WHEN by_gtin THEN 'gtin' WHEN by_key THEN 'structural' ELSE 'fuzzy' END AS match_method,
      n_platforms >= 2 AND NOT by_gtin AND NOT by_key AS review_needed
    FROM (SELECT h.label, h.canonical_id, h.gtin, h.n_platforms, coalesce(vv.variant_slug, 'unknown') AS variant_slug, vc.container,
        coalesce(vz.is_zero, FALSE) AS is_zero, coalesce(vs.sub_brand, '') AS sub_brand,
        coalesce(g.many, FALSE) AS by_gtin, coalesce(k.many, FALSE) AS by_key
      FROM (SELECT label, row_number() OVER (ORDER BY min(offer_ord)) - 1 AS canonical_id,
          coalesce(max(nullif(gtin_norm, '')), '') AS gtin, count(DISTINCT platform) AS n_platforms FROM {source} GROUP BY label) h
      LEFT JOIN {vote('variant_slug', "nullif(variant_slug, 'unknown')")} vv ON vv.label = h.label
      LEFT JOIN {vote('container', 'container')} vc ON vc.label = h.label
      LEFT JOIN {vote('is_zero', 'is_zero')} vz ON vz.label = h.label
      LEFT JOIN {vote('sub_brand', "nullif(sub_brand, '')")} vs ON vs.label = h.label
      LEFT JOIN (SELECT label, bool_or(n > 1) AS many FROM (SELECT label, count(DISTINCT platform) AS n FROM {source}
        WHERE gtin_norm <> '' GROUP BY label, gtin_norm) GROUP BY label) g ON g.label = h.label
      LEFT JOIN (SELECT label, bool_or(n > 1) AS many FROM (SELECT label, count(DISTINCT platform) AS n FROM {source}
        WHERE structural_key IS NOT NULL GROUP BY label, structural_key) GROUP BY label) k ON k.label = h.label) q
    JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN gtin_norm <> '' THEN 0 ELSE 1 END,
        CASE platform WHEN 'pedidosya' THEN 0 WHEN 'rappi' THEN 1 ELSE 9 END, length(nombre), offer_ord) AS rn
      FROM {source}) WHERE rn = 1) r ON r.label = q.label""",
        [source],
    )
    part(
        f"matched{suffix}",
        f"SELECT o.*, c.canonical_id, c.canonical_key FROM {source} o JOIN canonicals{suffix} c ON c.label = o.label",
        [source, f"canonicals{suffix}"],
    )


canonical_parts("resolved")
canonical_parts("resolved_exact", "_exact")

part(
    "cells",
    """
    SELECT *, coalesce(stock, 0) <> 0 AND coalesce(precio_actual, 0) > 0 AS disponible,
      CASE WHEN promo_tipo = 'multi' AND coalesce(promo_precio_efectivo, 0) <> 0 THEN promo_precio_efectivo END AS efectivo
    FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id, platform ORDER BY coalesce(nullif(precio_actual, 0), 1e12), offer_ord) AS rn,
        min(offer_ord) OVER (PARTITION BY canonical_id, platform) AS first_ord FROM matched) WHERE rn = 1""",
    ["matched"],
)
part(
    "guarded",
    """
    SELECT c.*, c.disponible AND coalesce(m.n >= 3 AND c.precio_actual < CAST(0.45 AS DOUBLE) * m.mid, FALSE) AS suspect
    FROM cells c LEFT JOIN (SELECT canonical_id, len(l) AS n,
        CASE WHEN len(l) % 2 = 1 THEN l[(len(l) + 1) // 2] ELSE (l[len(l) // 2] + l[len(l) // 2 + 1]) / CAST(2 AS DOUBLE) END AS mid
      FROM (SELECT canonical_id, list_sort(list(precio_actual)) AS l FROM cells WHERE disponible GROUP BY canonical_id)) m
      ON m.canonical_id = c.canonical_id""",
    ["cells"],
)
_SAVING = rounded("max(precio_actual) - min(precio_actual)")
part(
    "best_shop",
    f"""
    SELECT canonical_id, (min({{'p': precio_actual, 'o': first_ord, 's': platform}})).s AS mejor,
      CASE WHEN count(*) > 1 THEN {_SAVING} ELSE CAST(0 AS DOUBLE) END AS ahorro_abs
    FROM guarded WHERE disponible AND NOT suspect GROUP BY canonical_id""",
    ["guarded"],
)
part(
    "matrix",
    """
    SELECT c.canonical_id, c.canonical_key, c.brand_display, c.sub_brand, c.variant_slug, c.volume_ml, c.container, c.pack_qty,
      c.display_name, c.gtin, c.n_platforms, c.match_method, c.review_needed, b.mejor, coalesce(b.ahorro_abs, 0) AS ahorro_abs
    FROM canonicals c LEFT JOIN best_shop b ON b.canonical_id = c.canonical_id""",
    ["canonicals", "best_shop"],
)
part(
    "metrics",
    """
    SELECT m.*, g.min_price, g.min_price_promo, g.min_per_100ml, g.max_discount, g.has_promo
    FROM matrix m JOIN (SELECT canonical_id,
        min(CASE WHEN disponible THEN precio_actual END) AS min_price,
        min(CASE WHEN disponible THEN least(precio_actual, coalesce(efectivo, precio_actual)) END) AS min_price_promo,
        min(CASE WHEN disponible THEN nullif(precio_por_100ml, 0) END) AS min_per_100ml,
        max(coalesce(descuento_pct, 0)) AS max_discount, bool_or(efectivo IS NOT NULL) AS has_promo
      FROM cells GROUP BY canonical_id) g ON g.canonical_id = m.canonical_id""",
    ["matrix", "cells"],
)
part(
    "lowest",
    f"SELECT canonical_key, run_ts, {rounded('min(precio_actual)')} AS p FROM history "
    "WHERE precio_actual > 0 AND stock > 0 AND canonical_key <> '' GROUP BY 1, 2",
    ["history"],
)
part(
    "shop_prices",
    f"""
    SELECT canonical_key, platform, run_ts, {rounded('p')} AS precio, {rounded('coalesce(d, 0)', 1)} AS descuento_pct,
      pe AS promo_etiqueta, CASE WHEN pe IS NOT NULL AND coalesce(pp, 0) <> 0 THEN {rounded('pp')} END AS precio_efectivo
    FROM (SELECT canonical_key, platform, run_ts, min(precio_actual) AS p, max(descuento_pct) AS d,
        max(promo_etiqueta) AS pe, min(promo_precio_efectivo) AS pp FROM history
      WHERE precio_actual > 0 AND stock > 0 AND canonical_key <> '' GROUP BY 1, 2, 3)""",
    ["history"],
)
part(
    "series",
    """
    SELECT canonical_key, run_ts, p FROM (SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY run_ts DESC) AS rn,
      count(*) OVER (PARTITION BY canonical_key) AS n FROM lowest) WHERE rn <= 60 AND n >= 2""",
    ["lowest"],
)
part(
    "shop_series",
    """
    SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY canonical_key) AS n FROM (SELECT * EXCLUDE (rn) FROM
      (SELECT *, row_number() OVER (PARTITION BY canonical_key, platform ORDER BY run_ts DESC) AS rn FROM shop_prices) WHERE rn <= 48)) WHERE n >= 2""",
    ["shop_prices"],
)
part(
    "closes",
    """
    SELECT canonical_key, platform, dia, precio, descuento_pct, promo_etiqueta, precio_efectivo FROM (SELECT *,
      row_number() OVER (PARTITION BY canonical_key, platform, dia ORDER BY run_ts DESC) AS rn
      FROM (SELECT *, CAST(run_ts - INTERVAL 3 HOUR AS DATE) AS dia FROM shop_series)) WHERE rn = 1""",
    ["shop_series"],
)
part(
    "shown_days",
    "SELECT * EXCLUDE (rk) FROM (SELECT *, dense_rank() OVER (PARTITION BY canonical_key ORDER BY dia DESC) AS rk FROM closes) WHERE rk <= 21",
    ["closes"],
)
part(
    "last_runs",
    """SELECT platform, max(run_ts) AS last_run FROM obs WHERE run_ts <= (SELECT max(run_ts) FROM obs)
    - (CASE platform WHEN 'coto' THEN 1 WHEN 'dia' THEN 2 WHEN 'jumbo' THEN 9 WHEN 'vea' THEN 30 ELSE 0 END) * INTERVAL 1 DAY GROUP BY platform""",
    ["obs"],
)
# Runs of a month each, for series that are kept run by run.
part("monthly", "SELECT * REPLACE (date_trunc('month', run_ts) AS run_ts) FROM history", ["history"])
for _name in ("lowest", "shop_prices", "series", "shop_series"):
    _text, _needs = PARTS[_name]
    for _source, _other in (("FROM history", "FROM monthly"), ("FROM lowest", "FROM monthly_lowest"), ("FROM shop_prices", "FROM monthly_shop_prices")):
        _text = _text.replace(_source, _other)
    part(f"monthly_{_name}", _text, [{"history": "monthly"}.get(n, f"monthly_{n}") for n in _needs])
part(
    "health",
    """
    SELECT platform, last_run >= top - INTERVAL 3 DAY AS ok, last_run < top AND last_run >= top - INTERVAL 3 DAY AS stale,
      CASE WHEN last_run < top AND last_run >= top - INTERVAL 3 DAY THEN strftime(last_run, '%Y-%m-%dT%H:%M:%SZ') END AS captured_at,
      CASE WHEN last_run < top - INTERVAL 3 DAY THEN last_run END AS last_seen
    FROM last_runs, (SELECT max(last_run) AS top FROM last_runs)""",
    ["last_runs"],
)
