"""Query of the archive writer and reader."""

from __future__ import annotations

from seqweft.llm.common import table
from seqweft.llm.registry import query
from seqweft.llm.warc import archive_folder, read_archives, write_archives


@query("op8_warc")
def warc_round_trip(spark, sf):
    folder = archive_folder(spark)
    write_archives(table(spark, sf, "pages").select("page_id", "url", "html"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
