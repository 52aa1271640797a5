"""Settings from the environment and a ``.env`` file, with checks. What the environment says comes first."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

from .functions.text import extension_list, safe_name

LLM_MODEL, EMBED_MODEL = "qwen3.6:27b", "bge-m3"  # fixed values
BACKENDS = ("pypdf", "docling", "docling+formula")


@dataclass(frozen=True)
class Endpoint:
    base_url: str
    api_key: str
    model: str


def read_env(path: str | Path = ".env") -> dict[str, str]:
    """NAME=value lines of a file, if it is there; blank lines and those that begin with # are passed over, quotes around a value go."""
    found = {}
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, is_, value = line.strip().removeprefix("export ").partition("=")
            if is_ and not name.startswith("#"):
                value = value.strip()
                found[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return found


def _endpoint(prefix: str, model: str, given: Mapping[str, str] | None = None) -> Endpoint:
    e = os.environ if given is None else given
    return Endpoint(e.get(f"{prefix}_BASE_URL", "http://localhost:11434/v1"), e.get(f"{prefix}_API_KEY", "none"), e.get(f"{prefix}_MODEL", model))


@dataclass(frozen=True)
class Settings:
    courses_dir: str = "courses"
    outputs_dir: str = "outputs"
    index_dir: str = "index"
    extensions: str = ".pdf"
    pdf_backend: str = "pypdf"
    chunk_size: int = 250
    chunk_overlap: int = 25
    top_k: int = 5
    num_questions: int = 10
    temperature: float = 0.3
    max_retries: int = 3
    request_timeout: float = 900.0
    llm: Endpoint = field(default_factory=lambda: _endpoint("LLM", LLM_MODEL))
    embed: Endpoint = field(default_factory=lambda: _endpoint("EMBED", EMBED_MODEL))

    def __post_init__(self):
        for name in ("courses_dir", "outputs_dir", "index_dir"):
            object.__setattr__(self, name, str(Path(getattr(self, name)).expanduser().absolute()))
        checks = {
            "pdf_backend": self.pdf_backend in BACKENDS, "chunk_size": self.chunk_size >= 50, "chunk_overlap": 0 <= self.chunk_overlap < self.chunk_size,
            "top_k": self.top_k >= 1, "num_questions": self.num_questions >= 1, "temperature": 0 <= self.temperature <= 2,
            "max_retries": self.max_retries >= 0, "request_timeout": self.request_timeout > 0,
        }
        if bad := [k for k, ok in checks.items() if not ok]:
            raise ValueError("out of range: " + ", ".join(f"{k}={getattr(self, k)!r}" for k in bad))

    @classmethod
    def from_environment(cls, env_file: str | Path = ".env") -> Settings:
        said = read_env(env_file) | os.environ
        given = {}
        for f in fields(cls):
            if f.name not in ("llm", "embed") and (raw := said.get(f.name.upper())) is not None:
                given[f.name] = {"int": int, "float": float}.get(f.type, str)(raw)
        return cls(**given, llm=_endpoint("LLM", LLM_MODEL, said), embed=_endpoint("EMBED", EMBED_MODEL, said))

    @property
    def suffixes(self) -> tuple[str, ...]:
        return extension_list(self.extensions)

    def course_dir(self, course: str) -> Path:
        return Path(self.courses_dir) / course

    def index_path(self, course: str) -> str:
        return f"{self.index_dir}/{safe_name(course)}"

    def output_path(self, course: str, kind: str) -> Path:
        return Path(self.outputs_dir) / f"{safe_name(course)}_{kind}.md"

    def ensure_dirs(self) -> None:
        for d in (self.outputs_dir, self.index_dir):
            Path(d).mkdir(parents=True, exist_ok=True)

    def profile(self, dimension: int) -> dict[str, str]:
        """What an index depends on; a change of any of it asks for a rebuild."""
        return {"embed_model": self.embed.model, "dimension": str(dimension), "chunk_size": str(self.chunk_size), "chunk_overlap": str(self.chunk_overlap), "pdf_backend": self.pdf_backend, "schema": "1"}
