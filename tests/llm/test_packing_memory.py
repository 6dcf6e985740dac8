"""What a packing worker keeps of words stays bounded, and ids do not depend on it."""

from panelforge.llm import packing


def test_encoder_keeps_a_bounded_memory_within_one_text(monkeypatch):
    monkeypatch.setattr(packing, "CHUNKS", 50)
    monkeypatch.setattr(packing, "MEMORY", 50)
    enc = packing.Encoder(None)
    assert enc.by_chunk
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{i}-{i % 7}" for i in range(700)]
    texts = ["", " ".join(words[:60] * 3 + words[-5:]), " ".join(words), "x" * 5000 + " " + "ab1" * 2000]
    assert enc.encode(texts) == enc._slow(texts)
    assert enc.encode(texts) == enc._slow(texts)
    kept = [v for v in vars(enc).values() if isinstance(v, dict)]
    assert kept and all(len(d) <= 50 for d in kept)
    assert max(len(w) for d in kept for w in d) <= 128
