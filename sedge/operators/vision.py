"""Array steps around image models; the models themselves are given by the caller as ONNX bytes or a function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def letterbox(image: np.ndarray, height: int, width: int, fill: int = 114) -> tuple[np.ndarray, float, tuple[int, int]]:
    """An image scaled to fit, with borders; the scale and the border."""
    r = min(height / image.shape[0], width / image.shape[1])
    h, w = max(1, round(image.shape[0] * r)), max(1, round(image.shape[1] * r))
    rows, cols = (np.arange(h) / r).astype(int).clip(0, image.shape[0] - 1), (np.arange(w) / r).astype(int).clip(0, image.shape[1] - 1)
    out = np.full((height, width, *image.shape[2:]), fill, image.dtype)
    top, left = (height - h) // 2, (width - w) // 2
    out[top : top + h, left : left + w] = image[rows][:, cols]
    return out, r, (top, left)


def normalised(image: np.ndarray, mean=(0.485, 0.456, 0.406), std=(0.229, 0.224, 0.225)) -> np.ndarray:
    """Channels first, scaled and centred."""
    return ((image.astype(np.float32) / 255 - np.array(mean, np.float32)) / np.array(std, np.float32)).transpose(2, 0, 1)


def ctc_decode(probabilities: np.ndarray, alphabet: str, least: float = 0.5) -> list[tuple[str, float]]:
    """Greedy decoding of (lines, steps, classes), class 0 being blank; lines under ``least`` are empty."""
    out = []
    for line in probabilities:
        best, p = line.argmax(axis=1), line.max(axis=1)
        keep = (best != 0) & np.concatenate([[True], best[1:] != best[:-1]])
        score = float(p[keep].mean()) if keep.any() else 0.0
        out.append(("".join(alphabet[k - 1] for k in best[keep]) if score >= least else "", score))
    return out


def boxes_of_map(heat: np.ndarray, threshold: float = 0.3, box_threshold: float = 0.5, unclip: float = 1.5) -> list[tuple[int, int, int, int, float]]:
    """Boxes (x0, x1, top, bottom, score) around the connected places of a heat map, widened by area over outline."""
    on, seen, out = heat > threshold, np.zeros(heat.shape, bool), []
    for y, x in zip(*np.nonzero(on), strict=True):
        if seen[y, x]:
            continue
        stack, ys, xs = [(y, x)], [], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            ys.append(a)
            xs.append(b)
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < heat.shape[0] and 0 <= d < heat.shape[1] and on[c, d] and not seen[c, d]:
                    seen[c, d] = True
                    stack.append((c, d))
        score = float(heat[ys, xs].mean())
        if score >= box_threshold:
            h, w = max(ys) - min(ys) + 1, max(xs) - min(xs) + 1
            grow = int(round(h * w * unclip / (2 * (h + w))))
            out.append((max(0, min(xs) - grow), min(heat.shape[1], max(xs) + 1 + grow), max(0, min(ys) - grow), min(heat.shape[0], max(ys) + 1 + grow), score))
    return out


def suppressed(boxes: np.ndarray, scores: np.ndarray, least: float) -> list[int]:
    """Boxes (x0, x1, top, bottom) that stay, the best first, when those that overlap a better one go."""
    order, kept = list(np.argsort(-scores, kind="stable")), []
    area = (boxes[:, 1] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 2])
    while order:
        i = order.pop(0)
        kept.append(int(i))
        rest = np.array(order, int)
        if not len(rest):
            break
        w = np.maximum(0, np.minimum(boxes[i, 1], boxes[rest, 1]) - np.maximum(boxes[i, 0], boxes[rest, 0]))
        h = np.maximum(0, np.minimum(boxes[i, 3], boxes[rest, 3]) - np.maximum(boxes[i, 2], boxes[rest, 2]))
        union = area[i] + area[rest] - w * h
        order = [int(j) for j in rest[(w * h) / np.maximum(union, 1e-9) <= least]]
    return kept


def apply_model(images: Column, load: Callable[[], Callable[[list[bytes]], list]], schema: str, batch: int = 16) -> Column:
    """A model over images (bytes) in batches; ``load`` runs once per worker and gives the function for a batch. A null image gives null."""

    @F.pandas_udf(schema)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            out: list = [None] * len(part)
            at = [i for i, b in enumerate(part) if b is not None]
            for k in range(0, len(at), batch):
                own = at[k : k + batch]
                for i, r in zip(own, model([bytes(part.iloc[i]) for i in own]), strict=True):
                    out[i] = r
            yield pd.Series(out, dtype=object)

    return run(images)


def onnx_model(content: bytes, prepare: Callable, finish: Callable, threads: int = 2) -> Callable[[], Callable]:
    """A loader for ``apply_model`` from the bytes of an ONNX model."""

    def load():
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = threads
        session = ort.InferenceSession(content, options, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda images: finish(session.run(None, {name: prepare(images)}))

    return load
