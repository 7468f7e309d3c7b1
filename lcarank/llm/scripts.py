"""Scripts of letters by ranges of code points."""

from __future__ import annotations

import unicodedata

import numpy as np

from lcarank.llm.common import worker_state

#: First and last code points of the blocks that scripts' letters lie in.
RANGES = """
latin 41-5A 61-7A AA BA C0-D6 D8-F6 F8-2AF 1E00-1EFF 2C60-2C7F A720-A7FF AB30-AB6F FB00-FB06 FF21-FF3A FF41-FF5A
greek 370-3FF 1F00-1FFF
cyrillic 400-52F 1C80-1C8F 2DE0-2DFF A640-A69F
armenian 531-58A FB13-FB17
hebrew 590-5FF FB1D-FB4F
arabic 600-6FF 750-77F 8A0-8FF FB50-FDFF FE70-FEFF
devanagari 900-97F A8E0-A8FF
bengali 980-9FF
gurmukhi A00-A7F
gujarati A80-AFF
tamil B80-BFF
telugu C00-C7F
kannada C80-CFF
malayalam D00-D7F
sinhala D80-DFF
thai E00-E7F
lao E80-EFF
tibetan F00-FFF
georgian 10A0-10FF 1C90-1CBF 2D00-2D2F
ethiopic 1200-139F 2D80-2DDF
khmer 1780-17FF
hangul 1100-11FF 3130-318F A960-A97F AC00-D7FF
kana 3040-30FF 31F0-31FF FF66-FF9F
han 2E80-2FDF 3400-4DBF 4E00-9FFF F900-FAFF 20000-323AF
"""

SCRIPTS = [line.split()[0] for line in RANGES.strip().splitlines()] + ["other"]


def _table() -> np.ndarray:
    """Script number (from 1) of every code point that is a letter, else 0."""
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    script = np.where(letter, np.uint8(len(SCRIPTS)), np.uint8(0))
    for number, line in enumerate(RANGES.strip().splitlines(), 1):
        for part in line.split()[1:]:
            first, _, last = part.partition("-")
            span = slice(int(first, 16), int(last or first, 16) + 1)
            script[span] = np.where(letter[span], np.uint8(number), np.uint8(0))
    return script


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def letter_scripts(text: str) -> np.ndarray:
    """Script number of every code point of ``text``, 0 where it is no letter."""
    return script_table()[code_points(text)]


def script_table() -> np.ndarray:
    return worker_state("script table", _table, small=True)
