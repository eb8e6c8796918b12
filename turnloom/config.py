"""Settings with typed defaults, read from environment variables where given."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping
from dataclasses import dataclass

#: The system message that is put in front where a conversation has none.
DEFAULT_SYSTEM = "你是一个活泼开朗的男生，和想要进一步追求的女生进行对话。对话需要简短且自然流畅口语化。请务必确保使用简体中文进行回复"


@dataclass(frozen=True)
class Settings:
    max_seq_len: int = 2048
    max_seq_len_gpu: int = 4096
    ignore_label: int = -100
    pad_id: int = 151643
    end_id: int = 151645
    think_end_id: int = 151668
    batch_size: int = 16
    epochs: int = 2
    peak_rate: float = 1e-4
    warmup_share: float = 0.03
    log_steps: int = 10
    history_length: int = 20
    temperature: float = 0.7
    top_p: float = 0.7
    max_tokens: int = 1024
    max_tokens_gpu: int = 4096
    stream: bool = False
    model_name: str = "chat-model"
    default_system: str = DEFAULT_SYSTEM

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Upper-case field names are looked up; bool is true for 'true' in any case."""
        env = os.environ if env is None else env
        found = {}
        for field in dataclasses.fields(cls):
            if (raw := env.get(field.name.upper())) is not None:
                kind = type(field.default)
                found[field.name] = raw.lower() == "true" if kind is bool else kind(raw)
        return cls(**found)


DEFAULTS = Settings()
