"""Content hashes, namespaces and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry import lexicon as lx


def content_hash(c: Column) -> Column:
    return F.left(F.sha2(c, 256), F.lit(16))


def text_hash(c: Column) -> Column:
    return F.md5(c)


def normalised_url(url: Column) -> Column:
    """scheme://authority/path, without query string and fragment."""
    part = lambda name: F.coalesce(F.regexp_extract(url, _URL, name), F.lit(""))
    return F.concat(F.lower(part(1)), F.lit("://"), part(2), part(3))


_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def url_hash(url: Column) -> Column:
    return content_hash(normalised_url(url))


def sanitise_namespace(c: Column, limit: int = 40) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9\-]", "-"), r"-+", "-")
    return F.left(F.btrim(s, F.lit("-")), F.lit(limit))


def create_namespace(
    source: Column,
    content: Column | None = None,
    document_type: str = "document",
    environment: str = "development",
) -> Column:
    """Deterministic partition key of a document from its content or its source."""
    by_source = F.when(source.startswith("http"), url_hash(source)).otherwise(content_hash(source))
    key = by_source
    if content is not None:
        key = F.when(F.coalesce(content, F.lit("")) != "", content_hash(content)).otherwise(by_source)
    prefix = lx.ENVIRONMENT_PREFIX.get(environment, "dev")
    return sanitise_namespace(F.concat(F.lit(f"{prefix}_{document_type}_"), key))


def test_namespace(namespace: Column) -> Column:
    return F.when(namespace.startswith("test_"), namespace).otherwise(F.concat(F.lit("test_"), namespace))


def is_test_namespace(namespace: Column) -> Column:
    """Test and development namespaces, in the raw and in the sanitised spelling."""
    return namespace.rlike(r"^(?:test|dev)[-_]")


def chunk_key(namespace: Column, source: Column, policy_uin: Column, index: Column, text: Column) -> Column:
    """Stable chunk id; the namespace is part of the hashed key, so equal texts
    of two documents never share an id."""
    owner = F.concat_ws("", namespace, F.coalesce(source, F.lit("unknown")),
                        F.coalesce(policy_uin, F.lit("unknown")))
    return F.concat_ws("_", F.left(F.md5(owner), F.lit(8)), index.cast("string"),
                       F.left(F.md5(text), F.lit(8)))


def memo_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def struct_key(*cols: str) -> Column:
    """Key of several columns: md5 of their JSON with sorted field names."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])))


def context_hash(texts: Column, items: int = 10, chars: int = 100) -> Column:
    """Memo key of a ranked context: heads of its best texts."""
    heads = F.transform(F.slice(texts, 1, items), lambda t: F.left(t, F.lit(chars)))
    return F.md5(F.array_join(heads, "|"))
