"""A credential value that a base span covers in part only is judged, and hidden, whole."""

from maskwork.llm.secret_scan import find_secrets, redact


def test_values_beyond_a_base_span():
    text = "password: Tr0ub4dor!3xK#9z ok"
    assert find_secrets(text) == [("assign", 0, 19), ("guess", 10, 26)]
    assert redact(text, find_secrets(text)) == "[SECRET] ok"
    text = "the secret is " + "0123456789abcdef" * 2 + "!Qz8#w, see"
    assert find_secrets(text) == [("hex", 14, 46), ("guess", 14, 52)]
    assert redact(text, find_secrets(text)) == "the secret is [SECRET], see"
    text = "the token is AKIA" + "Z9Y8X7W6V5U4T3S2" + "%q&r."
    assert find_secrets(text) == [("access", 13, 33), ("guess", 13, 37)]
    assert redact(text, find_secrets(text)) == "the token is [SECRET]."


def test_values_inside_a_base_span_or_easy_to_guess():
    assert find_secrets("password: Tr0ub4dorX3xKq9z") == [("assign", 0, 26)]
    assert find_secrets("password: Tr0ub4dorX3xKq9z!") == [("assign", 0, 26)]
    assert find_secrets("password: password!password") == [("assign", 0, 18)]
