"""Policies and the fixed values that all detectors share."""

from __future__ import annotations

from dataclasses import dataclass, field

# Defaults of the scoring policy.
FLAG, BLOCK = 0.4, 0.85
MAX_SCAN_BYTES = 65536
DECODE_DEPTH = 2
HARD_BLOCK_RULES = ("unicode_tag_smuggling", "exfil_markdown_image", "exfil_url_lure", "template_forgery")
SOURCES = ("system", "user", "retrieved", "tool", "web", "email")
#: source -> (skip, always_escalate)
PER_SOURCE = {
    "system": (True, False),
    "user": (False, True),
    "retrieved": (False, True),
    "tool": (False, True),
    "web": (False, True),
    "email": (False, True),
}
SPECIAL_TOKENS = (
    "<|im_start|>", "<|im_end|>", "<|endofprompt|>", "<|begin_of_text|>", "<|end_of_text|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|eom_id|>", "[INST]", "[/INST]",
    "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<|tool|>", "<|resource|>",
    "<|assistant|>", "<|system|>", "<|user|>",
)
RTL_LOCALES = ("ar", "arc", "dv", "fa", "ha", "he", "iw", "khw", "ks", "ku", "ps", "ur", "yi")
LATIN_LOCALES = (
    "en", "fr", "es", "de", "it", "pt", "nl", "sv", "da", "no", "fi", "pl", "ro", "cs", "sk", "hu",
    "tr", "id", "vi", "sw", "ca", "eu",
)
SESSION_DECAY, SESSION_DELTA, SESSION_MANY_SHOT, SESSION_CUMULATIVE = 0.8, 0.3, 8, 0.6
SESSION_TTL_SECONDS, SESSION_TURNS = 1800, 50


@dataclass(frozen=True)
class Policy:
    """How evidence becomes a verdict."""

    mode: str = "enforce"  # or shadow, soft
    flag: float = FLAG
    block: float = BLOCK
    fail_mode: str = "open"  # or closed
    hard_block_rules: tuple[str, ...] | bool = HARD_BLOCK_RULES
    per_source: dict = field(default_factory=lambda: dict(PER_SOURCE))
    nfkc: bool = True
    strip_invisible: bool = True
    fold_confusables: bool = True
    bidi: str = "strip"  # or isolate, off
    decode_encoded: bool = True
    decode_depth: int = DECODE_DEPTH
    max_scan_bytes: int = MAX_SCAN_BYTES
    rtl_locales: tuple[str, ...] = RTL_LOCALES
    neutralize: str = "off"  # or strip, spotlight
    special_tokens: tuple[str, ...] = SPECIAL_TOKENS
    adversarial_suffix: bool = False
