"""Memory of the packing step's workers."""


def test_plain_texts_need_no_library_tokenizer():
    """Plain texts are encoded from the tables alone; the library's tokenizer is loaded for what needs it."""
    from quarrylake.llm import bpe

    t = bpe.WordBpe(bpe.default_path())
    texts = ["Plain words, 12 of them; and more.", "", "short\nlines"]
    got = [x.tolist() for x in t.encode(texts)]
    assert "whole" not in vars(t)
    odd = "it's <|odd|> 中文 " + "x" * 40
    assert t.encode([odd])[0].tolist() == t.whole.encode(odd, add_special_tokens=False).ids
    assert got == [t.whole.encode(x, add_special_tokens=False).ids for x in texts]
