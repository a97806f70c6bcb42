"""Units around every kind of white space are encoded as the library encodes the whole text."""

from __future__ import annotations

import public_tokenizers

from seagrid.llm.token_files import UnitEncoder


def test_every_kind_of_space():
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace() or i == 0x180E]
    texts = [f"one two{c}three, four {c}five\nsix{c}" for c in spaces] + [f"one two{c}three four" for c in spaces] + ["", " ", "plain words here\nand there"]
    encoder = UnitEncoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert encoder.encode(texts) == encoder._ids(texts) == encoder.encode(texts)
