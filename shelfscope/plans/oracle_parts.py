"""Shared pieces of the SQL statements that the Spark results are compared with."""

from __future__ import annotations

from shelfscope import fixed_values as fixed
from shelfscope.sources.aliases import parse_fixed


def quoted(value: str) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def values(rows: list[list[str]]) -> str:
    lines = [f"({', '.join(quoted(v) for v in row)}, {i})" for i, row in enumerate(rows)]
    return ", ".join(lines)


def rounded(x: str, digits: int = 2) -> str:
    """Half-even rounding of the exact binary value of x."""
    s = f"CAST({10**digits} AS DOUBLE)"
    k = "CAST(134217729 AS DOUBLE)"
    h = f"(({x}) * {s})"
    xh = f"(({x}) * {k} - (({x}) * {k} - ({x})))"
    e = f"(({xh} * {s} - {h}) + (({x}) - {xh}) * {s})"
    half = f"{h} - floor({h}) = CAST(0.5 AS DOUBLE)"
    return (
        f"((CASE WHEN {half} AND {e} > 0 THEN ceil({h}) WHEN {half} AND {e} < 0 THEN floor({h}) "
        f"ELSE round_even({h}, 0) END) / {s})"
    )


def norm(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower(coalesce({x}, ''))), '[^a-z0-9]+', ' ', 'g'))"


def discount(p: str, b: str) -> str:
    return (
        f"CASE WHEN coalesce({b}, 0) <> 0 AND coalesce({p}, 0) <> 0 AND {b} > {p} "
        f"THEN round_even((CAST(1 AS DOUBLE) - {p} / {b}) * CAST(10000 AS DOUBLE), 0) / CAST(100 AS DOUBLE) "
        "ELSE CAST(0 AS DOUBLE) END"
    )


def per_100ml(p: str, v: str) -> str:
    return (
        f"CASE WHEN coalesce({p}, 0) <> 0 AND coalesce({v}, 0) <> 0 "
        f"THEN round_even({p} / {v} * CAST(10000 AS DOUBLE), 0) / CAST(100 AS DOUBLE) END"
    )


def to_ml(value: str, unit: str) -> str:
    u = f"trim(lower(coalesce({unit}, '')))"
    return (
        f"CASE WHEN coalesce({value}, 0) <> 0 THEN CAST(round_even({value} * "
        f"CASE WHEN {u} IN ('l', 'lt', 'litro', 'litros') THEN CAST(1000 AS DOUBLE) "
        f"WHEN {u} = 'cl' THEN CAST(10 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, 0) AS INTEGER) END"
    )


EDGE = r"(?:[^\pL\pN_]|$)"  # word end that also knows letters with accents


def volume(name: str) -> str:
    pattern = rf"(?i)([0-9]+(?:[.,][0-9]+)?)\s*(ml|cc|cm3|l|lt|cl){EDGE}"
    number = f"TRY_CAST(replace(regexp_extract({name}, '{pattern}', 1), ',', '.') AS DOUBLE)"
    return to_ml(number, f"regexp_extract({name}, '{pattern}', 2)")


def type_text(name: str, brand: str) -> str:
    t = rf"regexp_replace(coalesce({name}, ''), '^Cerveza\s+', '', 'i')"
    t = (
        rf"CASE WHEN coalesce({brand}, '') <> '' THEN regexp_replace({t}, '\b' || regexp_escape({brand}) || '\b', '', 'gi') "
        f"ELSE {t} END"
    )
    t = rf"regexp_replace({t}, '\bCerveza\b', '', 'gi')"
    t = rf"regexp_replace({t}, '[0-9]+(?:[.,][0-9]+)?\s*(?:ml|cc|cm3|l|lt|cl)\b', '', 'gi')"
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'), ' ,-')"


def zero_alcohol(text: str) -> str:
    return rf"regexp_matches({text}, '(?i)0[.,]0|\bcero\b|sin alcohol|\bzero\b|\b0\s*0\b|0\s*%')"


def container(n: str) -> str:
    return (
        rf"CASE WHEN regexp_matches({n}, '\blata\b|\bcc\b') THEN 'lata' "
        rf"WHEN regexp_matches({n}, '\bbotella\b|\bporron\b|\blong neck\b') THEN 'botella' END"
    )


def pack(n: str) -> str:
    one = rf"regexp_extract({n}, '(?:^|\b)(?:pack\s*(?:de|x)?\s*)?([0-9]{{1,2}})\s*x\s*', 1)"
    two = rf"regexp_extract({n}, '\bx\s*([0-9]{{1,2}})\b', 1)"
    q = f"TRY_CAST(CASE WHEN {one} <> '' THEN {one} ELSE {two} END AS INTEGER)"
    return f"CASE WHEN {q} BETWEEN 2 AND 48 THEN {q} ELSE 1 END"


def promo_fields(text: str, price: str) -> str:
    """The five flat fields of the promotion of one text."""
    card = rf"regexp_matches({text}, '(?i)tarjeta|banco|mi\s*crf|cuotas|visa|master|galicia|santander')"
    n = rf"TRY_CAST(regexp_extract({text}, '(?i)\b([0-9])\s*[x×]\s*([0-9])\b', 1) AS INTEGER)"
    m = rf"TRY_CAST(regexp_extract({text}, '(?i)\b([0-9])\s*[x×]\s*([0-9])\b', 2) AS INTEGER)"
    off = rf"TRY_CAST(regexp_extract({text}, '(?i)\b(?:2|2d[oa]|2[ªa]|segunda)[^%0-9_\pL\pM][^%0-9]{{0,19}}([0-9]{{1,3}})\s*%', 1) AS INTEGER)"
    kind = (
        f"CASE WHEN coalesce({text}, '') = '' THEN '' WHEN {card} THEN 'tarjeta' "
        f"WHEN {m} >= 1 AND {m} < {n} AND {n} <= 6 THEN 'nxm' "
        f"WHEN {off} > 0 AND {off} <= 100 THEN 'segunda' ELSE '' END"
    )
    second = f"({price} * (CAST(2 AS DOUBLE) - {off} / CAST(100 AS DOUBLE)) / CAST(2 AS DOUBLE))"
    return f"""
      CASE ({kind}) WHEN 'nxm' THEN CAST({n} AS VARCHAR) || 'x' || CAST({m} AS VARCHAR)
        WHEN 'segunda' THEN '2do −' || CAST({off} AS VARCHAR) || '%' ELSE '' END AS promo_etiqueta,
      CASE WHEN ({kind}) = '' THEN '' ELSE trim({text}) END AS promo_texto,
      CASE ({kind}) WHEN 'nxm' THEN 'multi' WHEN 'segunda' THEN 'multi' WHEN 'tarjeta' THEN 'tarjeta' ELSE '' END AS promo_tipo,
      CAST(CASE ({kind}) WHEN 'nxm' THEN {n} WHEN 'segunda' THEN 2 ELSE 0 END AS INTEGER) AS promo_unidades,
      CASE WHEN coalesce({price}, 0) = 0 THEN NULL
        WHEN ({kind}) = 'nxm' THEN {rounded(f'{price} * {m} / {n}')}
        WHEN ({kind}) = 'segunda' AND {second} <> 0 THEN {rounded(second)} END AS promo_precio_efectivo"""


def own_key(c: dict[str, str]) -> str:
    return (
        f"{c['brand']} || CASE WHEN coalesce({c['sub']}, '') <> '' THEN '-' || {c['sub']} ELSE '' END || '|' || "
        f"{c['variant']} || '|' || coalesce(CAST(nullif({c['volume']}, 0) AS VARCHAR), '') || '|' || "
        f"coalesce({c['container']}, '') || '|' || CAST({c['pack']} AS VARCHAR) || '|' || "
        f"CASE WHEN {c['zero']} THEN 'z' ELSE '' END"
    )


def _products(source: str) -> str:
    return f"""
    SELECT q.*, {discount('q.precio_actual', 'q.precio_anterior')} AS descuento_pct,
      {per_100ml('q.precio_actual', 'q.volumen_ml')} AS precio_por_100ml,
      {promo_fields('q.promo_raw', 'q.precio_actual')}
    FROM (SELECT s.* EXCLUDE (descuento_pct), n.tipo, n.volumen_ml,
        s.precio_actual * (CAST(1 AS DOUBLE) + s.descuento_pct / CAST(100 AS DOUBLE)) AS precio_anterior
      FROM {source} s JOIN texts n ON n.nombre = s.nombre AND n.marca = s.marca) q"""


_KEY = {
    "brand": "n.brand_slug",
    "sub": "n.sub_brand",
    "variant": "n.variant_slug",
    "volume": "n.volume_ml_canon",
    "container": "n.container",
    "pack": "n.pack_qty",
    "zero": "n.is_zero",
}


def _normalised(source: str) -> str:
    return f"""
    SELECT p.*, n.* EXCLUDE (nombre, marca, tipo, volumen_ml), ltrim(trim(p.gtin), '0') AS gtin_norm,
      {own_key(_KEY)} AS own_key,
      CASE WHEN n.variant_slug <> 'unknown' AND coalesce(n.volume_ml_canon, 0) <> 0 THEN
        n.brand_slug || '|' || n.variant_slug || '|' || CAST(n.volume_ml_canon AS VARCHAR) || '|' ||
        CAST(n.pack_qty AS VARCHAR) || '|' || CAST(n.is_zero AS VARCHAR) END AS structural_key
    FROM {source} p JOIN named n ON n.nombre = p.nombre AND n.marca = p.marca"""


# Name -> (text, names it needs).
PARTS: dict[str, tuple[str, list[str]]] = {
    "obs": (
        """
    SELECT CASE l.l_suppkey % 8 WHEN 0 THEN 'carrefour' WHEN 1 THEN 'coto' WHEN 2 THEN 'dia' WHEN 3 THEN 'disco'
            WHEN 4 THEN 'jumbo' WHEN 5 THEN 'pedidosya' WHEN 6 THEN 'rappi' ELSE 'vea' END AS platform,
      p.p_partkey AS external_product_id, l.l_shipdate AS run_ts,
      l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_extendedprice,
      CONCAT('Cerveza ',
        CASE p.p_partkey % 6 WHEN 0 THEN 'Quilmes' WHEN 1 THEN 'Stella Artois' WHEN 2 THEN 'Andes Origen'
             WHEN 3 THEN 'Quilmes 1890' WHEN 4 THEN 'Patagonia' ELSE 'Pampa' END, ' ',
        CASE p.p_partkey % 7 WHEN 0 THEN 'Rubia' WHEN 1 THEN 'IPA' WHEN 2 THEN 'Roja' WHEN 3 THEN 'Negra'
             WHEN 4 THEN 'Única' WHEN 5 THEN '0.0' ELSE 'Scotch Ale' END, ' ',
        CASE WHEN p.p_size % 5 = 0 THEN 'pack x 6 ' ELSE '' END,
        CASE p.p_size % 4 WHEN 0 THEN '473ml' WHEN 1 THEN '354 cc' WHEN 2 THEN '1 L' ELSE '269 Ml' END,
        CASE l.l_suppkey % 3 WHEN 0 THEN ' Lata' WHEN 1 THEN ' Porrón' ELSE '' END) AS nombre,
      CASE WHEN p.p_partkey % 5 = 0 THEN '' ELSE CASE p.p_partkey % 6 WHEN 0 THEN 'Quilmes' WHEN 1 THEN 'Stella'
             WHEN 2 THEN 'Andes Origen' WHEN 3 THEN '1890' WHEN 4 THEN 'Patagonia' ELSE 'Pampa Brewing' END END AS marca,
      CASE WHEN l.l_suppkey % 8 IN (1, 6) OR p.p_partkey % 11 = 0 THEN ''
           ELSE CONCAT('0779', CAST(p.p_partkey AS VARCHAR(20))) END AS gtin,
      CASE WHEN p.p_partkey % 13 = 0 AND l.l_suppkey % 8 = 0 THEN CAST(0 AS DOUBLE)
           ELSE FLOOR(ROUND(p.p_retailprice * 100) * (80 + (l.l_suppkey * 7 + l.l_linenumber) % 41)
                  * (CASE WHEN l.l_linenumber = 7 AND l.l_suppkey % 8 = 1 THEN 30 ELSE 100 END) / CAST(10000 AS DOUBLE))
                / CAST(100 AS DOUBLE) END AS precio_actual,
      CAST(ROUND(l.l_discount * 100) AS INT) AS descuento_pct,
      CAST(l.l_quantity AS INT) % 7 AS stock,
      CASE l.l_linenumber % 6 WHEN 0 THEN '2x1' WHEN 1 THEN '2do al 50%' WHEN 2 THEN 'Tarjeta Banco 15%'
           WHEN 3 THEN '3x2 en la góndola' WHEN 4 THEN '' ELSE '25%Dto' END AS promo_raw
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
        [],
    ),
    "snap": (
        """
    SELECT * EXCLUDE (rn), (CASE platform WHEN 'carrefour' THEN 0 WHEN 'coto' THEN 1 WHEN 'dia' THEN 2
        WHEN 'disco' THEN 3 WHEN 'jumbo' THEN 4 WHEN 'pedidosya' THEN 5 WHEN 'rappi' THEN 6 ELSE 7 END)
        * CAST(1099511627776 AS BIGINT) + external_product_id AS offer_ord
    FROM (SELECT *, row_number() OVER (PARTITION BY platform, external_product_id
        ORDER BY run_ts DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn FROM obs)
    WHERE rn = 1""",
        ["obs"],
    ),
    "texts": (
        f"SELECT nombre, marca, {type_text('nombre', 'marca')} AS tipo, {volume('nombre')} AS volumen_ml "
        "FROM (SELECT DISTINCT nombre, marca FROM obs)",
        ["obs"],
    ),
    "products": (_products("snap"), ["snap", "texts"]),
    "obs_products": (_products("obs"), ["obs", "texts"]),
    "brand_alias": (
        f"SELECT * FROM (VALUES {values(parse_fixed(fixed.BRAND_ALIASES))}) t(alias, slug, display, sub, line)",
        [],
    ),
    "variant_alias": (
        f"SELECT * FROM (VALUES {values(parse_fixed(fixed.VARIANT_ALIASES))}) t(alias, slug, line)",
        [],
    ),
    "volume_alias": (
        f"SELECT CAST(raw AS INTEGER) AS raw, CAST(canon AS INTEGER) AS canon FROM (VALUES {values(parse_fixed(fixed.VOLUME_ALIASES))}) t(raw, canon, line)",
        [],
    ),
    "normal": (
        f"SELECT *, {norm('nombre')} AS nombre_norm, {norm('marca')} AS marca_norm, {norm('tipo')} AS tipo_norm, "
        f"{zero_alcohol("coalesce(tipo, '') || ' ' || coalesce(nombre, '')")} AS is_zero FROM texts",
        ["texts"],
    ),
    "brand_hit": (
        """
    SELECT nombre, marca, slug, display, sub FROM (
      SELECT n.nombre, n.marca, b.slug, b.display, b.sub, row_number() OVER (PARTITION BY n.nombre, n.marca
        ORDER BY CASE WHEN b.alias = n.marca_norm THEN 0 ELSE 1 END, length(b.alias) DESC, b.line) AS rn
      FROM normal n JOIN brand_alias b ON b.alias = n.marca_norm
        OR contains(' ' || n.nombre_norm || ' ', ' ' || b.alias || ' ')) WHERE rn = 1""",
        ["normal", "brand_alias"],
    ),
    "variant_hit": (
        """
    SELECT nombre, marca, slug FROM (
      SELECT n.nombre, n.marca, v.slug, row_number() OVER (PARTITION BY n.nombre, n.marca
        ORDER BY len(string_split(v.alias, ' ')) DESC, v.line) AS rn
      FROM normal n JOIN variant_alias v
        ON contains(' ' || n.tipo_norm || ' ' || n.nombre_norm || ' ', ' ' || v.alias || ' ')) WHERE rn = 1""",
        ["normal", "variant_alias"],
    ),
    "named": (
        f"""
    SELECT n.nombre, n.marca, n.tipo, n.volumen_ml, n.nombre_norm, n.is_zero,
      coalesce(b.slug, CASE WHEN n.marca_norm <> '' THEN replace(n.marca_norm, ' ', '-')
        WHEN n.nombre_norm <> '' THEN split_part(n.nombre_norm, ' ', 1) ELSE 'desconocida' END) AS brand_slug,
      coalesce(b.display, CASE WHEN n.marca_norm <> '' THEN trim(n.marca)
        WHEN n.nombre_norm <> '' THEN upper(substring(n.nombre_norm, 1, 1)) || substring(split_part(n.nombre_norm, ' ', 1), 2)
        ELSE 'Desconocida' END) AS brand_display,
      coalesce(b.sub, '') AS sub_brand,
      CASE WHEN n.is_zero THEN 'zero' ELSE coalesce(v.slug, 'unknown') END AS variant_slug,
      coalesce(a.canon, nullif(n.volumen_ml, 0)) AS volume_ml_canon,
      {container('n.nombre_norm')} AS container, CAST({pack('n.nombre_norm')} AS INTEGER) AS pack_qty
    FROM normal n LEFT JOIN brand_hit b ON b.nombre = n.nombre AND b.marca = n.marca
      LEFT JOIN variant_hit v ON v.nombre = n.nombre AND v.marca = n.marca
      LEFT JOIN volume_alias a ON a.raw = n.volumen_ml""",
        ["normal", "brand_hit", "variant_hit", "volume_alias"],
    ),
    "offers": (_normalised("products"), ["products", "named"]),
    "history_rows": (_normalised("obs_products"), ["obs_products", "named"]),
    "history": (
        """
    SELECT own_key AS canonical_key, platform, CAST(external_product_id AS VARCHAR) AS external_product_id, run_ts,
      precio_actual, descuento_pct, precio_por_100ml, stock, nullif(promo_etiqueta, '') AS promo_etiqueta,
      CASE WHEN promo_tipo = 'multi' THEN promo_precio_efectivo END AS promo_precio_efectivo
    FROM history_rows""",
        ["history_rows"],
    ),
}


def part(name: str, text: str, needs: list[str]) -> None:
    PARTS[name] = (text, needs)


def statement(body: str, *needs: str) -> str:
    """Full statement: the needed pieces in order, then the body."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for other in PARTS[name][1]:
            add(other)
        done.append(name)

    for name in needs:
        add(name)
    recursive = "RECURSIVE " if any(name in RECURSIVE for name in done) else ""
    pieces = ", ".join(
        f"{name} AS {'' if name in RECURSIVE else 'MATERIALIZED '}({PARTS[name][0]})" for name in done
    )
    if not done:
        return body
    if body.startswith("WITH "):
        return f"WITH {recursive}{pieces}, {body[5:]}"
    return f"WITH {recursive}{pieces} {body}"


RECURSIVE: set[str] = set()
