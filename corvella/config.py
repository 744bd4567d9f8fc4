"""Options of the document and e-mail pipelines, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Options:
    chunk_size: int = 1200
    chunk_overlap: int = 300
    token_max: int = 500
    token_overlap: int = 50
    token_vocabulary: str = ""
    semantic_max: int = 1500
    semantic_min: int = 400
    similarity_max: int = 1500
    similarity_threshold: float = 0.8
    linguistic_max: int = 2000
    linguistic_min: int = 500
    linguistic_threshold: float = 0.5
    chunk_batch: int = 300
    embedding_calls: int = 7
    embedding_attempts: int = 3
    embedding_pause: float = 1.0
    embedding_timeout: float = 30.0
    email_batch: int = 20
    email_wait_seconds: float = 5.0
    email_batches_at_once: int = 3
    email_embedding_calls: int = 3
    email_text_limit: int = 500
    fetches_at_once: int = 8
    fetch_timeout: float = 30.0
    max_upload_bytes: int = 50 * 1024 * 1024
    max_attachment_bytes: int = 10 * 1024 * 1024
    attachment_types: str = "pdf, txt, docx"
    max_retries: int = 3

    def __post_init__(self):
        if not 1 <= self.email_batch <= 100:
            raise ValueError("email_batch must lie between 1 and 100")
        if not 0 < self.email_wait_seconds <= 60:
            raise ValueError("email_wait_seconds must lie between 0 and 60")
        if not 1 <= self.email_batches_at_once <= 10:
            raise ValueError("email_batches_at_once must lie between 1 and 10")

    def embedder(self) -> dict[str, float]:
        """How embedding.embed is called for chunks."""
        return {"batch": self.chunk_batch, "attempts": self.embedding_attempts, "pause": self.embedding_pause, "at_once": self.embedding_calls, "timeout": self.embedding_timeout}

    def mail_embedder(self) -> dict[str, float]:
        """How it is called for mails: a batch of mails at a time."""
        return self.embedder() | {"batch": self.email_batch, "at_once": self.email_embedding_calls}

    def batcher(self) -> dict[str, float]:
        """How microbatch.batches and its streams are called."""
        return {"n": self.email_batch, "wait_seconds": self.email_wait_seconds}

    def fetcher(self) -> dict[str, float]:
        """How mail.fetch is called."""
        return {"at_once": self.fetches_at_once, "timeout": self.fetch_timeout}

    @classmethod
    def of(cls, spark: SparkSession) -> Options:
        """Defaults, overridden by spark.corvella.<name>."""
        found = {}
        for name, kind in cls.__annotations__.items():
            value = spark.conf.get(f"spark.corvella.{name}", None)
            if value is not None:
                found[name] = {"int": int, "float": float, "str": str}[kind](value)
        return cls(**found)
