"""Stand-ins for models, so that the queries and tests run where no weights exist."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping
from typing import Any

import numpy as np


class HashEncoder:
    """Stand-in model: components are SHA-256 bytes scaled to [-1, 1].

    Equal inputs get equal vectors and different ones unrelated vectors. It has
    no meaning beyond that; it makes jobs testable where no weights exist.
    """

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def _encode(self, content: bytes) -> np.ndarray:
        digest = b""
        block = 0
        while len(digest) < self.dimension:
            digest += hashlib.sha256(f"{block}:".encode() + content).digest()
            block += 1
        values = np.frombuffer(digest, dtype=np.uint8)[: self.dimension]
        return ((values - 127.5) / 127.5).astype(np.float32)

    def encode_text(self, texts: list[str]) -> list[np.ndarray]:
        return [self._encode(text.encode()) for text in texts]

    def encode_image(self, images: list[bytes]) -> list[np.ndarray]:
        return [self._encode(image) for image in images]


class PickyEncoder(HashEncoder):
    """Takes inputs of up to ``longest`` bytes and refuses others, with the batch they are in."""

    def __init__(self, dimension: int, longest: int) -> None:
        super().__init__(dimension)
        self.longest = longest

    def encode_image(self, images: list[bytes]) -> list[np.ndarray]:
        if any(len(image) > self.longest for image in images):
            raise ValueError(f"more than {self.longest} bytes")
        return super().encode_image(images)


class PatternTagger:
    """Stand-in tagger: each pattern's matches become entities, left to right."""

    def __init__(self, patterns: Mapping[str, str]) -> None:
        self.patterns = {entity: re.compile(pattern) for entity, pattern in patterns.items()}

    def tag(self, texts: list[str]) -> list[list[dict[str, Any]]]:
        tagged = []
        for text in texts:
            found = [
                {"entity": entity, "word": m.group(), "start": m.start(), "end": m.end(), "score": 1.0}
                for entity, pattern in self.patterns.items()
                for m in pattern.finditer(text)
            ]
            tagged.append(sorted(found, key=lambda hit: (hit["start"], hit["end"], hit["entity"])))
        return tagged
