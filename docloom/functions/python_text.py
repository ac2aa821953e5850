"""The few text functions that parsers need in Python; the column versions are in `text`."""

from __future__ import annotations

import re

_INVISIBLE = dict.fromkeys(map(ord, "​‌‍﻿⁠­"))


def normalize_whitespace(text: str) -> str:
    text = re.sub(r"\r\n?", "\n", text).translate(_INVISIBLE)
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text))
    return "\n".join(map(str.strip, text.split("\n")))
