"""Archives close at their size, each with its own dictionary."""

import random
import struct
from pathlib import Path

import pytest

from leafline.llm import warc

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("limit", [1, 3000, 1 << 30])
def test_archives_of_a_stated_size(spark, tmp_path, limit):
    r = random.Random(4)
    words = ["<p>", "</p>", "some", "text", "héllo", "x" * 50]
    hot = "<html>" + " ".join(r.choices(words, k=400))
    pages = [(i, f"u{i}", hot if i % 2 else " ".join(r.choices(words, k=r.randint(9, 300)))) for i in range(600)] + [(1000, "big", "".join(r.choices("abcdefgh", k=200_000))), (1001, None, None), (1002, "", "")]
    path = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame(pages, PAGES).repartition(3), path, archive_bytes=limit)
    files = [f.read_bytes() for f in Path(path).glob("part-*") if f.stat().st_size]
    assert all(struct.unpack_from("<I", f)[0] == warc.DICTIONARY_MAGIC for f in files)
    assert [len(list(warc.iter_frames(f))) > 0 for f in files] == [True] * len(files)
    if limit == 1:
        assert len(files) > 4  # a sample of records at least
    if limit == 3000:
        assert len(files) > 20
    got = {x.page_id: x for x in warc.read_archives(spark, path).collect()}
    assert len(got) == len(pages)
    for i, url, html in pages:
        if html == hot and i != 599:
            assert (got[i].record_type, got[i].refers_to, got[i].html) == ("revisit", 599, None)
        elif i != 1001:
            assert (got[i].record_type, got[i].html, got[i].url) == ("response", html, url)
    assert (got[1001].record_type, got[1001].refers_to) == ("revisit", 1002)


def test_a_closed_archive_loses_no_record():
    records = [bytes([65 + k % 26]) * (k % 97 * 50) + b"end" for k in range(900)]
    for limit in (1, 500, 20_000, 1 << 30):
        found = [x for archive in warc._archives(iter(records), limit) for x in warc.iter_frames(archive)]
        assert found == records
