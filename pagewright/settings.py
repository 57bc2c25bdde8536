"""Settings of a run from the environment, with defaults for what is unset or senseless."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace

# Names of variables, words that mean yes.
YES = frozenset(("true", "1", "yes", "on"))
REQUIRED = ("BASE_URL", "API_KEY", "MODEL")


def whole(env: Mapping[str, str], name: str, default: int) -> int:
    """A whole number above zero; the default where it is none."""
    try:
        found = int(env.get(name, default))
    except ValueError:
        return default
    return found if found > 0 else default


def flag(env: Mapping[str, str], name: str, default: bool = False) -> bool:
    return default if name not in env else env[name].strip().lower() in YES


@dataclass(frozen=True)
class Settings:
    """What a run needs to know; made by `load`, changed by `with_model`."""

    base_url: str = ""
    api_key: str = ""
    model: str = ""
    calls: int = 3
    remote: bool = False
    remote_cpu: bool = False
    remote_detector: bool = False
    remote_pages: int = 2
    local_pages: int = 2
    password: str = ""

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        url, key, model = (env.get(x, "") for x in REQUIRED)
        numbers = [whole(env, name, default) for name, default in (("TRANSLATION_MAX_CONCURRENT_CALLS", 3), ("MODAL_MAX_PARALLEL_PAGES", 2), ("LOCAL_MAX_PARALLEL_PAGES", 2))]
        flags = [flag(env, name) for name in ("USE_MODAL", "USE_MANGAOCR_CPU", "USE_DETECTION_MODEL")]
        return cls(url, key, model, numbers[0], *flags, *numbers[1:], env.get("GRADIO_ACTION_PASSWORD", ""))

    def with_model(self, model: str) -> Settings:
        return replace(self, model=model)

    @property
    def pages(self) -> int:
        """Pages at once."""
        return self.remote_pages if self.remote else self.local_pages

    def check(self) -> None:
        """Raise ValueError with all that is missing or too small."""
        lacking = [name for name, value in zip(REQUIRED, (self.base_url, self.api_key, self.model), strict=True) if not value.strip()]
        if lacking:
            raise ValueError(f"not set: {', '.join(lacking)}")
        if min(self.remote_pages, self.local_pages) < 1:
            raise ValueError("at least one page at once")
