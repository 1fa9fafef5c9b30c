"""Persistence for Python models that hold fitted sub-models.

A composite model is saved as its params metadata plus one sub-directory per sub-model
(each saved with its own writer) and optional JSON payload, so a ``PipelineModel``
containing it saves and loads like any other.
"""

from __future__ import annotations

import importlib
import json

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter


def _cls(name: str):
    mod, _, attr = name.rpartition(".")
    return getattr(importlib.import_module(mod), attr)


class _CompositeWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        subs = self.instance._sub_models()
        extra = {"sub_models": [f"{type(m).__module__}.{type(m).__name__}" for m in subs],
                 "payload": json.dumps(self.instance._payload())}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc, extraMetadata=extra)
        for i, m in enumerate(subs):
            m.write().overwrite().save(f"{path}/sub_{i}")
        self.instance._save_extra(path)


class _CompositeReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sc)
        subs = [_cls(n).load(f"{path}/sub_{i}") for i, n in enumerate(meta["sub_models"])]
        inst = self.cls()
        DefaultParamsReader.getAndSetParams(inst, meta)
        inst._restore(subs, json.loads(meta["payload"]), path)
        inst._resetUid(meta["uid"])
        return inst


class CompositeModelIO(MLReadable, MLWritable):
    """Mixin: implement ``_sub_models``, ``_payload`` and ``_restore``."""

    def _sub_models(self) -> list:
        return []

    def _payload(self) -> dict:
        return {}

    def _save_extra(self, path: str) -> None:
        return None

    def _restore(self, subs: list, payload: dict, path: str) -> None:
        return None

    def write(self) -> MLWriter:
        return _CompositeWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CompositeReader(cls)
