"""Declared schemas of the landed files and of the history table."""

from __future__ import annotations

from pyspark.sql import types as T

PRODUCT_FIELDS = {
    "id": "string",
    "nombre": "string",
    "marca": "string",
    "tipo": "string",
    "volumen_ml": "int",
    "precio_actual": "double",
    "precio_anterior": "double",
    "descuento_pct": "double",
    "precio_por_100ml": "double",
    "stock": "int",
    "gtin": "string",
    "promo_etiqueta": "string",
    "promo_texto": "string",
    "promo_tipo": "string",
    "promo_unidades": "int",
    "promo_precio_efectivo": "double",
    "beer_color": "string",
    "beer_style": "string",
    "abv": "double",
    "is_zero_alcohol": "boolean",
    "origen": "string",
}
PRODUCT_DDL = ", ".join(f"{name} {kind}" for name, kind in PRODUCT_FIELDS.items())

ENVELOPE_DDL = (
    "plataforma string, external_store_id string, tienda string, direccion string, "
    "fecha_scrapeo string, source map<string,string>, total int, con_descuento int, desde bigint, landing string, "
    f"productos array<struct<{PRODUCT_DDL.replace(' ', ':').replace(',:', ',')}>>"
)

MANIFEST_DDL = (
    "platform string, store string, landing string, parts bigint, listings bigint, captured string, "
    "landed_at timestamp, run_id string"
)

STORES_DDL = (
    "reference_address string, stores array<struct<platform:string,external_store_id:string,"
    "store_name:string,direccion:string,active:boolean,config:variant>>"
)

OBSERVATION_DDL = (
    "canonical_key string, platform string, external_product_id string, run_ts timestamp_ntz, "
    "precio_actual double, descuento_pct double, precio_por_100ml double, stock int, "
    "promo_etiqueta string, promo_precio_efectivo double"
)

# Payloads of the four kinds of source, only the fields that are read.
QUICK_COMMERCE_DDL = (
    "id string, name string, defaultBrandName string, size struct<content:double,unit:string>, "
    "pricing struct<price:double,beforePrice:double>, stock int, gtin string"
)

STOREFRONT_PRODUCT = (
    "struct<product_id:string,name:string,trademark:string,quantity:double,unit_type:string,"
    "price:double,real_price:double,stock:int,in_stock:boolean,ean:string,"
    "complex_discounts:array<string>,"
    "attributes:struct<beer_color:string,beer_style:string,abv:double,is_zero_alcohol:boolean,"
    "beer_origin:string>>"
)
_TEASER = "struct<Name:string,`<Name>k__BackingField`:string>"
CATALOG_DDL = (
    "productId string, productName string, brand string, items array<struct<itemId:string,"
    "nameComplete:string,ean:string,sellers:array<struct<commertialOffer:struct<Price:double,"
    f"ListPrice:double,AvailableQuantity:int,Teasers:array<{_TEASER}>,"
    f"PromotionTeasers:array<{_TEASER}>>>>>>"
)

SEARCH_DDL = (
    "value string, data struct<id:string,sku_plu:string,sku_display_name:string,"
    "product_brand:string,product_list_price:double,price:array<struct<listPrice:double>>,"
    "discounts:array<struct<discountText:string>>>"
)


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
