"""How chunks are put together for the search of the pieces."""

from gatewaylens.llm import sentencepiece_suffix as pieces_of
from gatewaylens.llm.registered import TOKENIZER


def test_pieces_are_searched_in_order_and_ids_do_not_depend_on_how_chunks_are_batched(monkeypatch):
    pieces = pieces_of.load_pieces(TOKENIZER)
    texts = [pieces.texts[i] for i in pieces.ids]
    assert texts == sorted(texts)
    docs = ["one two  three", "naïve \U0001F600 ünïcode words\nand lines", "", None, " ".join(f"w{n}ord{n * 7}" for n in range(300))]
    found = []
    for symbols in (40, 1000, pieces_of.SYMBOLS_AT_ONCE):
        monkeypatch.setattr(pieces_of, "SYMBOLS_AT_ONCE", symbols)
        pieces.forget()
        found.append([x.tolist() for x in pieces_of.encode_texts(docs, TOKENIZER)])
    assert found[0] == found[1] == found[2]
