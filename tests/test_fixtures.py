"""What the sample views keep while they number rows."""

import pytest

from leafmill.operators import ordering
from leafmill.plans import fixtures as fx

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def kept(monkeypatch):
    """Columns of everything that numbering writes to the checkpoint folder."""
    seen = []
    keep = ordering.keep

    def watch(df):
        seen.append(df.columns)
        return keep(df)

    monkeypatch.setattr(ordering, "keep", watch)
    monkeypatch.setattr(ordering, "has_large_group", lambda *_: True)
    return seen


def test_numbering_keeps_no_text(spark, kept):
    texts = {"text", "ocr_markdown", "ocr_text_plain", "user_memo"}
    pages = fx.pages(spark, FOLDER, "src7").collect()
    assert sorted(r.page_number for r in pages) == list(range(1, len(pages) + 1))
    notes = fx.notes(spark, FOLDER).collect()
    assert sorted(r.id for r in notes) == list(range(1, len(notes) + 1))
    assert len(kept) == 2 and not any(texts & set(columns) for columns in kept)
