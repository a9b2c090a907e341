"""op9: metadata and conversion records of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import warc
from tracewell.llm.registry import register, table


def _replaced(text: str, pairs) -> str:
    for old, new in pairs:
        text = f"replace({text}, '{old}', '{new.replace(chr(39), chr(39) * 2)}')"
    return text


_SEEN = r"regexp_replace(html, '<!--.*?-->', ' ', 'gs')"
for _name in warc.SILENT:
    _SEEN = rf"regexp_replace({_SEEN}, '<{_name}\b[^>]*>.*?</{_name}\s*>', ' ', 'gsi')"

WARC_SQL = rf"""
with p as (
  select page_id, url, coalesce(html, '') html, md5('response|' || coalesce(url, '') || '|' || coalesce(page_id::varchar, '')) h from pages
), r as (
  select *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' refers_to,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html)) head,
    {_SEEN} seen
  from p
), t as (
  select *, regexp_replace(regexp_replace(seen, '[\t\r\n\f ]+', ' ', 'g'), '</?(?:{warc.BREAKING})\b[^>]*>', chr(10), 'gi') lines from r
), d as (
  select *, {_replaced("regexp_replace(lines, '<[/!?a-zA-Z][^>]*>', '', 'g')", warc.ENTITIES)} plain from t
), b as (
  select page_id, url, refers_to, 'conversion' warc_type, 'text/plain' content_type,
    regexp_replace(regexp_replace(regexp_replace(plain, ' +', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') block
  from d
  union all
  select page_id, url, refers_to, 'metadata', 'application/json',
    to_json(struct_pack(
      warc := struct_pack("WARC-Type" := 'response', "WARC-Record-ID" := refers_to, "WARC-Target-URI" := url, "WARC-Date" := '{warc.DATE}',
        "WARC-Block-Digest" := 'sha256:' || sha256(head || chr(13) || chr(10) || chr(13) || chr(10) || html), "WARC-Payload-Digest" := 'sha256:' || sha256(html)),
      status := 'HTTP/1.1 200 OK',
      headers := ['Content-Type: text/html; charset=utf-8', 'Content-Length: ' || octet_length(encode(html))],
      title := {_replaced("trim(regexp_extract(seen, '(?is)<title[^>]*>(.*?)</title', 1))", warc.ENTITIES)},
      links := list_transform(regexp_extract_all(seen, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"''>]*)', 1), lambda x: {_replaced("x", warc.ENTITIES)})
    ))::varchar
  from d
), i as (select *, md5(warc_type || '|' || refers_to) h from b)
select page_id, warc_type, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' record_id,
  refers_to, url target_uri, '{warc.DATE}' warc_date, content_type, octet_length(encode(block))::bigint content_length, 'sha256:' || sha256(block) block_digest, block
from i
"""


@register("op9_warc_derivatives", WARC_SQL)
def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records per page: page_id, warc_type, record_id, refers_to, target_uri, warc_date,
    content_type, content_length, block_digest, block."""
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))
