import pytest

pytest.importorskip("leafwise.llm")
