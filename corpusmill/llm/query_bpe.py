"""op4: tokens of all documents."""

from __future__ import annotations

import public_tokenizers

from .bpe import encode
from .common import read
from .registry import query

VOCABULARY = "byte_bpe_50k.json"


@query("op4_bpe_tokens")
def bpe_tokens(spark, folder):
    return encode(read(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), ids=False)
