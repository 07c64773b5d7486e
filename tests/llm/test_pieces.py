"""Pieces that are encoded one after another have the ids that they have alone."""

import pytest
from sparkquarry.llm import tokenfile
from sparkquarry.llm.bpe import default_path


@pytest.mark.parametrize("together", [1, 3, 64])
def test_joined_pieces_have_the_ids_of_each(together, monkeypatch):
    monkeypatch.setattr(tokenfile, "TOGETHER", together)
    codec = tokenfile.LibraryCodec(default_path())
    pieces = [" a", "b", " c ", "  d", " \u00e9\u00fc", " \u65e5\u672c", " \U0001f642", "\n\nx", " it's", " \u2003y", " 12,5", " " + "z" * 300, "\u3000", " a"]
    alone = [codec.library.encode(p, add_special_tokens=False).ids for p in pieces]
    assert [memoryview(x).cast("I").tolist() for x in codec._new(pieces)] == alone
    plain = [(p, ids) for p, ids in zip(pieces, alone, strict=True) if p[0] == " " and not p[-1].isspace()]
    marked = []
    monkeypatch.setattr(codec, "_marked", lambda own: marked.extend(own) or iter(()))
    assert [memoryview(x).cast("I").tolist() for x in codec._joined([p for p, _ in plain])] == [ids for _, ids in plain]
    assert not marked


def test_a_table_keeps_to_its_bytes():
    from sparkquarry.llm.pieces import PieceTable

    made = {f"k{i}": b"1234" for i in range(50)} | {"x" * 65: b"1234"}
    whole, part, none = PieceTable(1 << 20), PieceTable(1000), PieceTable(99)
    for t in (whole, part, none):
        t._keep(made)
    assert len(whole.table) == 50 and 0 < len(part.table) < 50 and part.room >= 0 and not none.table
