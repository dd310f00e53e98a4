"""Fixed schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, BOOLEAN, STRING = T.LongType(), T.IntegerType(), T.BooleanType(), T.StringType()
STRINGS = T.ArrayType(STRING)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PAGES = struct(page_id=LONG, url=STRING, html=STRING)

LISTING_PAGES = struct(collection_url=STRING, page_no=INT, html=STRING, has_next=BOOLEAN)

PAGE_FACTS = struct(
    page_id=LONG, url=STRING, success=BOOLEAN, error=STRING, title=STRING, meta_desc=STRING,
    h1=STRING, body_text=STRING, product_links=STRINGS, bad_links=INT,
)

ANCHORS = T.ArrayType(
    struct(ordinal=INT, href=STRING, link=STRING, visible=BOOLEAN, scopes=INT)
)

REQUESTS = struct(
    request_id=LONG, brand_name=STRING, website_url=STRING, collection_url=STRING,
    collection_topic=STRING, target_market=STRING, keywords=STRING, competitor_urls=STRINGS,
    product_links=STRINGS, brand_info=STRING, output_language=STRING, skip_products=BOOLEAN,
)

OVERRIDES = struct(request_id=LONG, role=STRING, url=STRING, content=STRING, version=LONG)

HISTORY_RECORD = struct(
    domain=STRING, brand_name=STRING, website_url=STRING, target_market=STRING,
    keywords_pool=STRINGS, competitor_urls=STRING, brand_info=STRING, last_updated=STRING,
)

POOL_EDITS = struct(domain=STRING, pos=INT, op=STRING, value=STRING)

ANSWER_LINES = struct(request_id=LONG, seq=LONG, line=STRING)

FRAGMENTS = struct(request_id=LONG, seq=LONG, fragment=STRING, last=BOOLEAN)

RELAY_EVENTS = struct(request_id=LONG, seq=LONG, type=STRING, text=STRING, message=STRING)

GENERATIONS = struct(request_id=LONG, n_chunks=LONG, text=STRING, status=STRING, message=STRING)
