import pytest

pytest.importorskip("sitewise.llm")
