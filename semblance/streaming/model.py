"""Running a model over images in the workers: loaded once for each process, fed in batches bounded by bytes, with errors for single images.

The model itself, and the decoding of pixels, are the caller's: `load` returns a function that takes a list of images and returns for each
a list of its faces. It is called when a worker process meets its first image, and what it returns stays with the process
for all later tasks under the name given.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from semblance.functions.images import orientation_of, upright

#: What this process has loaded, by name.
_LOADED: dict[str, Callable] = {}
#: Bytes of images that a model gets at a time; a larger image comes alone.
BATCH_BYTES = 32 << 20
FACE = "face_index int, bbox array<double>, det_score double, face_px double, embedding array<float>, error string"
_NAMES = [c.split(" ")[0] for c in FACE.split(", ")]


def loaded(name: str, load: Callable[[], Callable]) -> Callable:
    """The model of that name, loaded if this process has not met it."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def decoded(content: bytes, decode: Callable[[bytes], np.ndarray]) -> np.ndarray:
    """Pixels of a file as they are to be shown: decoded by the caller, turned by its orientation."""
    return upright(decode(content), orientation_of(content))


def _runs(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of rows of about so many bytes."""
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if i > at and held + size > most:
            yield slice(at, i)
            at, held = i, 0
        held += size
    if at < len(sizes):
        yield slice(at, len(sizes))


def _said(e: Exception) -> str:
    return "".join(traceback.format_exception_only(e)).strip()[:500]


def _faces(model: Callable, images: list, names: list) -> list[list[tuple]]:
    """Rows of each image. If a batch fails its images go one by one, so a broken one costs itself alone."""
    try:
        found = model(images)
        if len(found) != len(images):
            raise ValueError(f"the model gave {len(found)} answers for {len(images)} images")
    except Exception as e:
        if len(images) == 1:
            return [[(*names[0], *(None for _ in _NAMES[:-1]), _said(e))]]
        return [_faces(model, [x], [n])[0] for x, n in zip(images, names, strict=True)]
    return [[(*n, i, f.get("bbox"), f.get("det_score"), f.get("face_px"), f.get("embedding"), None) for i, f in enumerate(faces)] or [(*n, *(None for _ in _NAMES))] for n, faces in zip(names, found, strict=True)]


def detected(images: DataFrame, name: str, load: Callable[[], Callable], decode: Callable[[bytes], np.ndarray] | None = None, keys: tuple[str, ...] = ("uid", "photo_id"), batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The keys of images (keys, content) with a row for each face; one with no face_index where an image has none, and one with an
    `error` where it cannot be decoded or the model fails on it. decode: the model gets upright pixels instead of files."""
    kinds = dict(images.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            contents = [bytes(c) if c is not None else b"" for c in b["content"]]
            named = list(b[list(keys)].itertuples(index=False, name=None))
            for part in _runs([len(c) for c in contents], batch_bytes):
                rows, good, of = [], [], []
                for content, own in zip(contents[part], named[part], strict=True):
                    try:
                        good.append(decoded(content, decode) if decode else content)
                        of.append(own)
                    except Exception as e:
                        rows.append((*own, *(None for _ in _NAMES[:-1]), _said(e)))
                if good:
                    rows += [r for own in _faces(loaded(name, load), good, of) for r in own]
                yield pd.DataFrame(rows, columns=[*keys, *_NAMES]).astype({"face_index": "Int32"})

    return images.select(*keys, "content").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + FACE)
