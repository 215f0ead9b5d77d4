"""Token ids with small caches against the tokenizer itself."""

import public_tokenizers

from jostle.llm import tokens


def test_small_caches_change_no_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"Wort{k % 7}! \u00c9t\u00e9, na\u00efve... {k} a<|startoftext|>b \u0130x \u65e5\u672c -- it's" for k in range(300)] + ["", " \n"]
    small, whole = tokens.WordEncoder(path, limit=3), tokens.WordEncoder(path)
    for at in range(0, len(texts), 20):
        part = texts[at : at + 20]
        plain = [b"".join(i.to_bytes(4, "little") for i in whole.tokenizer.encode(t, add_special_tokens=False).ids) for t in part]
        assert small.pack(part) == whole.pack(part) == plain
    assert len(whole.coded) == whole.tokenizer.get_vocab_size()
