"""Host names by labels against the standard on whole hosts."""

import idna

from entigraph.functions import text as T


def test_hosts_label_by_label():
    def whole(host):
        try:
            return idna.encode(host, uts46=True).decode()
        except Exception:
            return None

    labels = ["münich", "sup1", "a--b", "xn--mnich-kva", "-a", "a_b", "", "ß", "日本。jp", "ü" * 63, "ü" * 57, "a" * 64, "א1", "́a", "a­", "ａ", "X", "℡", "…", "a‍b"]
    hosts = [f"{a}.{b}" for a in labels for b in labels] + [f"{a}.{b}.example" for a in labels for b in labels] + [".".join(["ü" * 20] * 9), ".".join(["ü" * 20, *["a" * 40] * 6])]
    hosts = [h for h in hosts if not h.isascii()]
    assert [T._encoded_host(h) for h in hosts] == [whole(h) for h in hosts]
    T._encoded.cache_clear()
    assert [T._encoded_host(f"münich.sup{i}.example") for i in range(1000)] == [f"xn--mnich-kva.sup{i}.example" for i in range(1000)]
    assert T._encoded.cache_info().misses == 1
