"""Values that must stay as they are, apart from the constants that the SQL checks share with the code."""

from talkmill.functions import codes, language
from talkmill.operators import messages


def _ends(lists):
    return {code: (len(words), list(words)[0], list(words)[-1]) for code, words in lists.items()}


def test_language_lists():
    assert _ends(language.LETTERS) == {'tw': (3, 'ɔ', 'ŋ'), 'ga': (3, 'ɛ', 'ŋ'), 'ee': (5, 'ɖ', 'ʋ'), 'dag': (2, 'ŋ', 'ɣ')}
    assert _ends(language.COMMON_WORDS) == {'tw': (34, 'yɛ', 'ɔmpɛ'),
     'ga': (16, 'ni', 'yao'),
     'ee': (15, 'nye', 'ɖo'),
     'dag': (16, 'n', 'buɣu')}
    assert _ends(language.FARM_TERMS) == {'tw': (12, 'afuom', 'mako')}


def test_codes_and_commands():
    assert codes.LANGUAGE_NAMES_LONG == {'en': 'English', 'tw': 'Twi (Akan)', 'ga': 'Ga', 'ee': 'Ewe', 'dag': 'Dagbani'}
    assert messages.WELCOME_COMMANDS == ("/start", "hello", "hi") and messages.HELP_COMMANDS == ("/help",)
    assert len(messages.AUDIO_TYPES) == 11 and messages.MAX_UPLOAD_BYTES == 10485760
