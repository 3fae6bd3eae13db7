"""Profiles: every pattern, word list, weight and threshold of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Function words of the legal corpus in the form in which the index holds tokens.
LEGAL_STOP = tuple(
    "la va cua co đuoc cho trong khi thi nao gi toi khong mot cac nhung nay đo voi ve nhu đe tu đen bi boi hay hoac neu ma o ra "
    "vao theo se đa phai can muon hoi xin a vay the sao bao nhieu ai đau lam nhat hien".split()
)
#: Structure of legal texts (Java dialect; lines end at line feeds only).
ARTICLE = r"[ \t]*(?:Điều|Ðiều|ĐIỀU)[ \t]+(\d+[a-zA-Z]?)[ \t]*[.．:·]"
CHAPTER = r"[ \t]*(?:Chương|CHƯƠNG|Phần|PHẦN|Mục|MỤC)[ \t]+(?:[IVXLCDM\d]+[a-zA-Z]?)(?U:\b)[^\n]*"
CLAUSE = r"[ \t]*\d{1,2}[ \t]*[.)][ \t]+(?=[^\d])"
ANNEX = r"[ \t]*(?:PHỤ LỤC|Phụ lục)(?U:\b)"
CONTINUED = "[tiếp] "
EXPIRED = "Hết hiệu lực"


@dataclass(frozen=True)
class Profile:
    """Defaults are the reference figures; pass a changed copy to tune."""

    article: str | None = ARTICLE
    chapter: str | None = CHAPTER
    clause: str | None = CLAUSE
    annex: str | None = ANNEX
    continued: str = CONTINUED
    stop: tuple[str, ...] = LEGAL_STOP
    chunk_chars: int = 2400
    least_chars: int = 50
    doc_chars: int = 400_000
    annex_after: int = 2000
    preamble_chars: int = 1200
    title_chars: int = 250
    chunk_max_tier: int = 1
    vector_max_tier: int = 0
    query_chars: int = 2000
    query_tokens: int = 24
    phrases: int = 4
    max_df_ratio: float | None = None
    df_floor: int = 2000
    per_source: int = 40
    terms_per_source: int = 15
    rrf_k: int = 60
    rerank_candidates: int = 32
    context_top: int = 8
    context_chars: int = 24_000
    qa_weights: dict = field(default_factory=lambda: {"question": 3.0, "answer": 1.0})
    term_weights: dict = field(default_factory=lambda: {"term": 5.0, "definition": 1.0})
    doc_weights: dict = field(default_factory=lambda: {"title": 1.0, "doc_number": 8.0, "issuer": 1.0, "title_vi": 6.0, "number_vi": 8.0, "doc_type": 4.0})


LEGAL = Profile()
#: For texts without articles: the whole text is one body, cut at line feeds.
GENERIC = Profile(article=None, chapter=None, clause=None, annex=None, stop=tuple("the of and to in a is that".split()))
