"""Which parts of a chunk the tokenizer gets, and that their ids are the whole text's."""

import random

import numpy as np
import pyarrow as pa

from pixsieve.llm import tokens


def test_cores_and_punctuation():
    chunks = pa.array(["Word***", "wörd&&&", "WÖRD", "it's", "it'", "a<|endoftext|>.", "İ.", "שׁ.", "x́,", "..."])
    core, tail = (x.to_pylist() for x in tokens.parted(chunks))
    assert list(zip(core, tail, strict=True)) == [
        ("word", "***"), ("wörd", "&&&"), ("wörd", ""), ("it's", ""), ("it", "'"), ("a<|endoftext|>.", ""), ("İ.", ""), ("שׁ.", ""), ("x́,", ""), ("...", ""),
    ]


def test_ids_of_parts_are_those_of_the_text():
    path, pick = tokens.default_vocabulary(), random.Random(5)
    tok = tokens.tokenizer(path)[0]
    assert tokens.letter_tokenizer(path) is not None
    signs = "שׁक़ΩaAbBsStTéÉÀÿßŸİıſΣς×÷'.,!*<|>-_ \x01\x7f0９½²ª̸́é —日"
    texts = ["".join(pick.choice(signs) for _ in range(pick.randint(0, 14))) for _ in range(4000)]
    texts += ["<|endoftext|>", "a<|endoftext|>.", "foo's.", "foo'll***", "x\"'s", "Zİ,", "Straße!!", "'re."]
    ids, ends = tokens.encoded(pa.array(texts), path, tokens.END_ID, np.dtype("<u2"))
    for text, a, b in zip(texts, [0, *ends[:-1]], ends, strict=True):
        assert ids[a:b].tolist() == [*tok.encode(text, add_special_tokens=False).ids, tokens.END_ID], text
