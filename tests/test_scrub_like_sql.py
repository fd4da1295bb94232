"""Texts on which look-arounds, Unicode classes and whole decoding differ from the oracle SQL."""

import duckdb
import pytest

from plumbline import registry

TEXTS = [
    "030 1234567890,030 1234567890",
    " +49 30 1234567890,030-123-456-7890",
    "55.95.145.182 030 1234567890 030-123-456-7890 4886775454209063",
    "12345678 901 23456 78901 23456 7890 12345 678 901234 567 890123 45678",
    "b\u00b20301234567890 \u203f0301234567890 x\x0b0301234567890\x0b",
    "\u0663\u0664\u0665\u0666\u0667\u0668\u0669\u0660\u0661\u0662 \u00e976561191234567890 \u017fteamcommunity.com/id/a \u0130d",
    "\u00e9.com/x a.\u00fck/b c.u\u212a/d HTTP\u017f://x.y\x0bz @ab @cd,@ef",
    "0301234567890\n",
    None,
]
PAGES = ["&amp;lt; &lt;b&gt; &#39; &quot;&middot;", "\u3000\x0b a \x85\xa0", "[\u017f]x[\u212a=1]y[\u0131]z", " a \u2028", *TEXTS]


@pytest.mark.parametrize("name", ["scrub_phones", "clean_pages", "public_scrub", "scrub_pii_documents", "strip_markup_pages"])
def test_odd_texts_give_the_rows_of_sql(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = {tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == set(db.execute(registry.ORACLES[name]).fetchall())
