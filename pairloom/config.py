"""Settings of one pipeline run, held on the driver."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed ids of the four special pieces.
PAD, UNK, BOS, EOS = 0, 1, 2, 3
SPECIAL_PIECES = ("<pad>", "<unk>", "<s>", "</s>")


@dataclass(frozen=True)
class PipelineConfig:
    # The defaults of a run.
    src_lang: str = "en"
    tgt_lang: str = "vi"
    min_len: int = 3
    max_chars: int = 100
    length_ratio: float = 2.5
    vocab_size: int = 8000
    min_pair_freq: int = 1  # rarer pairs are not merged, even if the vocabulary stays short
    held_out: float = 0.2
    seed: int = 42
    batch_size: int = 32
    max_ids: int = 128
    patience: int = 5
    eval_rows: int = 100
    term_mode: str = "safe"  # "exact" keeps the debris of nested terms, see functions.text
    fit_on: str = "train"  # "all" learns subwords on every kept pair, before the split

    def __post_init__(self):
        if self.term_mode not in ("safe", "exact"):
            raise ValueError(f"term_mode must be 'safe' or 'exact', got {self.term_mode!r}")
        if self.fit_on not in ("train", "all"):
            raise ValueError(f"fit_on must be 'train' or 'all', got {self.fit_on!r}")
        if not 0 < self.held_out < 1:
            raise ValueError("held_out must lie between 0 and 1")
