"""Registration of the crawl functions for SQL users."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dredge.functions import web_url
from dredge.functions.columns import LOOSE_LINK
from dredge.functions.css_links import css_links
from dredge.functions.html_links import LINKS, extract
from dredge.functions.json_links import json_links
from dredge.functions.pdf_links import pdf_links
from dredge.functions.xml_links import xml_links


_PARTS = "filter(split({0}, '{1}'), x -> x <> '')"
_OFTEN = "exists({0}, x -> size(filter({0}, y -> y = x)) > 3)"
_SEGMENTS, _PAIRS = _PARTS.format("path", "/"), _PARTS.format("query", "&")
#: The default limits: over three times at all, or twice three times from ten segments on.
_LOOP = f"{_OFTEN.format(_SEGMENTS)} OR {_OFTEN.format(_PAIRS)} OR (size({_SEGMENTS}) >= 10 AND size(filter(array_distinct({_SEGMENTS}), x -> size(filter({_SEGMENTS}, y -> y = x)) >= 3)) >= 2)"


def register(spark: SparkSession) -> list[str]:
    """Register all functions; returns their names."""

    @F.pandas_udf(T.StructType([T.StructField("url", T.StringType()), T.StructField("error", T.StringType())]))
    def normalize_url(raw: pd.Series, parent: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([web_url.normalize(r, p) for r, p in zip(raw, parent, strict=True)], columns=["url", "error"])

    @F.pandas_udf(T.StringType())
    def resolve_url(raw: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or p is None else web_url.resolve(r, p) for r, p in zip(raw, page, strict=True)], dtype=object)

    def of_kind(kind: str):
        @F.pandas_udf(LINKS)
        def run(html: pd.Series, page: pd.Series) -> pd.Series:
            return pd.Series([[{"url": u, "kind": k, "tag": t} for u, k, t in extract(b, p) if k == kind] if b and p else [] for b, p in zip(html, page, strict=True)])

        return run

    found = {
        "normalize_url": normalize_url, "resolve_url": resolve_url, "url_to_string": web_url.url_to_string, "valid_url": web_url.valid_url,
        "html_outlinks": of_kind("outlink"), "html_assets": of_kind("asset"), "css_links": css_links, "json_links": json_links, "xml_links": xml_links, "pdf_links": pdf_links,
    }
    for name, f in found.items():
        spark.udf.register(name, f)
    macros = {
        "link_header": ("value STRING", "ARRAY<STRING>", r"filter(transform(split(value, ', '), x -> regexp_replace(trim(element_at(split(x, ';'), 1)), '^<|>$', '')), x -> x <> '')"),
        "text_links": ("body STRING", "ARRAY<STRING>", "array_distinct(regexp_extract_all(body, '" + LOOSE_LINK.replace("\\", "\\\\").replace("'", "\\'") + "', 0))"),
        "has_path_loop": ("path STRING, query STRING", "BOOLEAN", _LOOP),
        "reverse_host": ("hostport STRING", "STRING", r"CASE WHEN hostport RLIKE '^[0-9]{1,3}([.][0-9]{1,3}){3}(:[0-9]+)?$' OR startswith(hostport, '[') THEN hostport ELSE array_join(reverse(split(regexp_replace(lower(regexp_replace(hostport, ':[0-9]*$', '')), '[.]$', ''), '[.]')), '.') || regexp_extract(hostport, '(:[0-9]+)$', 1) END"),
        "decode_hops": ("path STRING", "INT", "regexp_count(path, 'L')"),
        "encode_hops": ("hops INT", "STRING", "repeat('L', hops)"),
    }
    for name, (args, kind, body) in macros.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return [*found, *macros]
