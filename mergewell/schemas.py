"""Shapes of the catalog, of seller entries and of run results."""

from __future__ import annotations

PRODUCT = "id long, name string, brand string, category string"
LINK = "id long, seller_name string, product_id long, seller_product_id string"
LEGACY_LINK = "id long, seller_name string, product_id long, seller_product_id long"
#: A decoded element before cleaning; the state of a field is missing, null, other (not a string) or text.
FIELDS = ("Id", "SellerName", "Name", "Brand", "Category")
RAW = {"Id": "raw_id", "SellerName": "raw_seller", "Name": "raw_name", "Brand": "raw_brand", "Category": "raw_category"}
CLEAN = {"Id": "seller_product_id", "SellerName": "seller_name", "Name": "name", "Brand": "brand", "Category": "category"}
REQUIRED = ("Id", "SellerName", "Name")
FLAGS = "array<struct<field:string,reason:string>>"
CHANGES = "array<struct<field:string,old:string,new:string>>"
