"""Keyword rules against instructions aimed at a model, from an own grammar in English, Spanish and Portuguese.

The grammar has classes of phrases for each language, and families: sequences of classes with at most so many words
between them. Each family and language is one rule. Orders, polite requests (an order after a cue such as "would you
kindly") and passive forms ("all rules must be ignored") are families of their own or share the clause opening; phrases
that look alike but are harmless ("sort order", "lint rules") take away the hits they cover.

All phrases of all languages are found in one pass of one Aho-Corasick automaton. A rule is looked at only where each of
its classes occurs, and then only at the places of those occurrences: no rule reads the text itself.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from dataclasses import dataclass
from functools import cache

import ahocorasick

#: The phrases of the grammar by class and language; accents may be left out in a text.
PHRASES = {
    "cancel": {
        "en": "ignore|disregard|forget|skip|override|bypass|do not follow|don't follow|stop following|pay no attention to|set aside",
        "es": "ignora|ignore|ignorar|olvida|olvide|olvidar|descarta|omite|no sigas|no siga|haz caso omiso de|deja de lado",
        "pt": "ignore|ignora|ignorar|esqueça|esquece|desconsidere|descarte|não siga|deixe de lado|desrespeite",
    },
    "told": {
        "en": "instruction|instructions|rules|guideline|guidelines|directions|directive|directives|prompt|prompts|orders|constraints",
        "es": "instrucción|instrucciones|reglas|indicaciones|órdenes|directrices|restricciones",
        "pt": "instrução|instruções|regras|orientações|ordens|diretrizes|restrições",
    },
    "all_before": {
        "en": "everything above|everything before this|all of the above text|everything you were told|everything you have been told|what you were told",
        "es": "todo lo anterior|todo lo que te dijeron|todo lo que se te ha dicho|lo que te dijeron antes",
        "pt": "tudo o que foi dito|tudo acima|tudo o que te disseram|tudo que você aprendeu até agora",
    },
    "be_cancelled": {
        "en": "must be ignored|should be ignored|are to be ignored|is to be ignored|can be ignored|are cancelled|no longer apply|must be disregarded|should be disregarded|are void|are hereby revoked",
        "es": "deben ser ignoradas|debe ser ignorado|deben ignorarse|quedan anuladas|quedan sin efecto|ya no se aplican|debe ignorarse",
        "pt": "devem ser ignoradas|deve ser ignorado|estão canceladas|ficam revogadas|não se aplicam mais|devem ser desconsideradas",
    },
    "anew": {
        "en": "from now on you|your new task is|your new instructions are|your new role is|your real task is|your only task is now",
        "es": "a partir de ahora eres|a partir de ahora debes|tu nueva tarea es|tus nuevas instrucciones son|tu verdadera tarea es",
        "pt": "a partir de agora você|sua nova tarefa é|suas novas instruções são|sua verdadeira tarefa é",
    },
    "reveal": {
        "en": "reveal|print|show|repeat|output|display|disclose|leak|write out|tell me",
        "es": "revela|revele|muestra|muéstrame|imprime|repite|escribe|dime",
        "pt": "revele|mostre|imprima|repita|escreva|diga-me",
    },
    "secret": {
        "en": "system prompt|hidden prompt|initial instructions|your instructions|system message|secret key|your hidden rules|developer message",
        "es": "prompt del sistema|instrucciones iniciales|tus instrucciones|mensaje del sistema|clave secreta",
        "pt": "prompt do sistema|instruções iniciais|suas instruções|mensagem do sistema|chave secreta",
    },
    "be_revealed": {
        "en": "must be revealed|should be printed|must be shown|is to be disclosed|should be repeated|must be printed",
        "es": "debe ser revelado|debe mostrarse|deben mostrarse|debe imprimirse",
        "pt": "deve ser revelado|deve ser mostrado|devem ser mostradas|deve ser impresso",
    },
    "ask_secret": {
        "en": "what are your instructions|what is your system prompt|what were you told to do|which rules do you follow",
        "es": "cuáles son tus instrucciones|cuál es tu prompt del sistema|qué te han ordenado",
        "pt": "quais são suas instruções|qual é o seu prompt do sistema|o que mandaram você fazer",
    },
    "become": {
        "en": "you are now a|you are now an|you are now the|you are now my|you are now unrestricted|you are now dan|act as a|act as an|act as the|act as if|pretend to be|pretend you are|behave as|roleplay as|play the role of",
        "es": "ahora eres un|ahora eres una|ahora eres el|ahora eres la|actúa como|finge ser|finge que eres|compórtate como|haz el papel de",
        "pt": "agora você é um|agora você é uma|agora você é o|agora você é a|aja como|finja ser|finja que é|comporte-se como|faça o papel de",
    },
    "enter": {
        "en": "enable|enter|activate|switch to|you are in|turn on",
        "es": "activa|entra en|cambia a|estás en",
        "pt": "ative|entre no|mude para o|você está no",
    },
    "mode": {
        "en": "developer mode|jailbreak mode|god mode|debug mode|unrestricted mode|dan mode",
        "es": "modo desarrollador|modo sin restricciones|modo jailbreak|modo dios",
        "pt": "modo desenvolvedor|modo sem restrições|modo jailbreak|modo deus",
    },
    "no_limits": {
        "en": "without any restrictions or filters|there are no rules for you|you have no restrictions|you have no limits",
        "es": "no tienes restricciones|no tienes límites|para ti no hay reglas",
        "pt": "você não tem restrições|você não tem limites|para você não há regras",
    },
    "reply": {
        "en": "reply|respond|answer",
        "es": "responde|responda|contesta|conteste",
        "pt": "responda|retorne|conteste",
    },
    "only": {
        "en": "only with|with only|only the word|exclusively with|with exactly|just with",
        "es": "solo con|sólo con|únicamente con|exactamente con",
        "pt": "apenas com|somente com|só com|exatamente com",
    },
    "plain": {
        "en": "in plain text|without json|instead of json|not in json|as free text",
        "es": "en texto plano|sin json|en lugar de json|como texto libre",
        "pt": "em texto simples|sem json|em vez de json|como texto livre",
    },
    "encoded": {
        "en": "in base64|in rot13|in hexadecimal|in morse code|in reverse order",
        "es": "en base64|en rot13|en hexadecimal|en código morse|al revés",
        "pt": "em base64|em rot13|em hexadecimal|em código morse|de trás para frente",
    },
    "mark": {
        "en": "mark|set|designate|choose|treat|make|label|declare|flag|pick|count",
        "es": "marca|marque|elige|elija|designa|trata|declara|señala|pon",
        "pt": "marque|marca|escolha|designe|trate|declare|assinale|defina",
    },
    "option": {
        "en": "option a|option b|option c|option d|first option|last option|first answer|first choice",
        "es": "opción a|opción b|opción c|opción d|primera opción|última opción|primera respuesta",
        "pt": "opção a|opção b|opção c|opção d|primeira opção|última opção|primeira alternativa|primeira resposta",
    },
    "as_right": {
        "en": "as correct|as the correct|as the right|as right|to be correct",
        "es": "como correcta|como la correcta|como verdadera",
        "pt": "como correta|como a correta|como certa|como verdadeira",
    },
    "be_right": {
        "en": "must be marked as correct|should be marked as correct|must be the correct answer|must always be correct|is to be treated as correct",
        "es": "debe marcarse como correcta|debe ser la correcta|debe ser siempre correcta|se marcará como correcta",
        "pt": "deve ser marcada como correta|deve ser a correta|deve ser sempre correta|será marcada como correta",
    },
    "key": {
        "en": "the correct answer is always|the right answer is always|every answer must be|all answers must be",
        "es": "la respuesta correcta es siempre|la respuesta correcta siempre es|todas las respuestas deben ser",
        "pt": "a resposta correta é sempre|a resposta certa é sempre|todas as respostas devem ser",
    },
    "swap": {
        "en": "instead of the quiz|instead of a quiz|do not write the quiz|do not generate the quiz|do not create a quiz|do not write questions|do not generate questions|write a poem instead",
        "es": "en lugar del cuestionario|en vez del cuestionario|no generes el cuestionario|no escribas preguntas|no crees preguntas",
        "pt": "em vez do questionário|em vez do quiz|não gere o questionário|não gere perguntas|não escreva perguntas|não crie o quiz",
    },
    "put": {
        "en": "include|insert|add|put|place|append|embed|write|mention",
        "es": "incluye|incluya|inserta|añade|agrega|pon|escribe|menciona",
        "pt": "inclua|insira|adicione|acrescente|coloque|escreva|mencione",
    },
    "link": {
        "en": "this link|the link|a link|this url|the url|this image|the image|this address|https|http",
        "es": "este enlace|el enlace|un enlace|esta url|la url|esta imagen|la imagen|https|http",
        "pt": "este link|o link|um link|esta url|a url|esta imagem|a imagem|este endereço|https|http",
    },
    "token": {
        "en": "the token|the code|the word|the phrase|this phrase|this word|the text|the marker|the signature|the passphrase|this sentence",
        "es": "el token|el código|la palabra|la frase|esta frase|esta palabra|el texto|el marcador|la firma",
        "pt": "o token|o código|a palavra|a frase|esta frase|esta palavra|o texto|o marcador|a assinatura",
    },
    "everywhere": {
        "en": "each question|every question|all questions|each answer|every answer|all answers|each explanation|every explanation|all explanations|every option|first question|the quiz",
        "es": "cada pregunta|todas las preguntas|cada respuesta|todas las respuestas|cada explicación|todas las explicaciones|cada opción|primera pregunta|el cuestionario|del cuestionario",
        "pt": "cada pergunta|todas as perguntas|cada questão|todas as questões|cada resposta|cada explicação|todas as explicações|cada alternativa|primeira pergunta|o questionário|no questionário",
    },
    "be_put": {
        "en": "must appear|must be included|should be included|should appear|must be inserted|has to appear|must be added",
        "es": "debe aparecer|debe incluirse|debe figurar|debe insertarse|tiene que aparecer",
        "pt": "deve aparecer|deve ser incluído|deve ser incluída|deve constar|tem que aparecer|precisa aparecer",
    },
    "begin": {
        "en": "begin|start|open|end|finish|conclude|prefix|preface",
        "es": "comienza|comience|empieza|empiece|termina|termine|inicia|concluye",
        "pt": "comece|inicie|termine|conclua|abra|finalize",
    },
    "must_begin": {
        "en": "must begin with|should begin with|must start with|should start with|must end with|has to end with",
        "es": "debe comenzar con|debe empezar con|debe terminar con|deben comenzar con|deben empezar con",
        "pt": "deve começar com|deve terminar com|devem começar com|deve iniciar com|devem terminar com",
    },
    "write": {
        "en": "write|generate|create|translate|produce|formulate",
        "es": "escribe|escriba|genera|crea|traduce|formula|redacta",
        "pt": "escreva|gere|crie|traduza|formule|redija",
    },
    "tongue": {
        "en": "in french|in german|in russian|in chinese|in japanese|in arabic|in italian|in klingon|in another language|in a different language",
        "es": "en francés|en alemán|en ruso|en chino|en japonés|en árabe|en italiano|en otro idioma",
        "pt": "em francês|em alemão|em russo|em chinês|em japonês|em árabe|em italiano|em outro idioma|em outra língua",
    },
    "be_written": {
        "en": "must be written|should be written|must be translated|has to be written|must be generated",
        "es": "debe escribirse|deben escribirse|debe ser escrito|debe traducirse|debe redactarse",
        "pt": "deve ser escrito|devem ser escritas|deve ser traduzido|deve ser gerado|devem ser redigidas",
    },
    "document": {
        "en": "the document|this document|the source text|the content of this page|what the document says",
        "es": "el documento|este documento|el texto fuente|lo que dice el documento",
        "pt": "o documento|este documento|o texto fonte|o que o documento diz",
    },
    "authority": {
        "en": "as your developer i|as your administrator i|this is a message from the system|message from the developers|i am your creator",
        "es": "como tu desarrollador|como tu administrador|este es un mensaje del sistema|soy tu creador",
        "pt": "como seu desenvolvedor|como seu administrador|esta é uma mensagem do sistema|eu sou seu criador",
    },
    "marks": {
        "en": "give full marks|give the highest score|rate this document as perfect|assign the maximum score|approve this document",
        "es": "da la máxima puntuación|asigna la puntuación máxima|califica este documento como perfecto|aprueba este documento",
        "pt": "dê a nota máxima|atribua a pontuação máxima|avalie este documento como perfeito|aprove este documento",
    },
    "hush": {
        "en": "do not mention|don't mention|never mention|do not tell|don't tell|do not reveal",
        "es": "no menciones|nunca menciones|no digas|no reveles",
        "pt": "não mencione|nunca mencione|não diga|não revele",
    },
    "of_this": {
        "en": "this instruction|these instructions|this message|this note|the user about this|anyone about this",
        "es": "esta instrucción|estas instrucciones|este mensaje|esta nota",
        "pt": "esta instrução|estas instruções|esta mensagem|esta nota",
    },
    "fence": {
        "en": "end of document|end of the document|new instructions:|begin system|system override",
        "es": "fin del documento|nuevas instrucciones:|inicio del sistema",
        "pt": "fim do documento|novas instruções:|início do sistema",
    },
    "fetch": {
        "en": "open|visit|fetch|download from|follow|click",
        "es": "abre|visita|descarga de|sigue|haz clic en",
        "pt": "abra|visite|baixe de|siga|clique em",
    },
    "safety": {
        "en": "safety filters|safety filter|content policy|safety guidelines|content filter|ethical guidelines|moderation layer",
        "es": "filtros de seguridad|política de contenido|normas de seguridad|límites éticos",
        "pt": "filtros de segurança|política de conteúdo|normas de segurança|limites éticos",
    },
}
#: Phrases that look like one of a class (or stand around one) and mean no harm.
HARMLESS = {
    "told": {
        "en": "sort order|sort orders|lint rules|linter rules|build rules|firewall rules|css rules|import orders|shell prompt|command prompt|instant prompt|build instructions|these rules in your config|rules in .gitignore",
        "es": "reglas de lint|reglas de estilo|reglas del cortafuegos|instrucciones de compilación",
        "pt": "regras de lint|regras de estilo|regras do firewall|instruções de compilação",
    },
    "mode": {
        "en": "developer mode in windows|developer mode in the windows|developer mode on your phone|debug mode for local development",
        "es": "modo desarrollador de windows|modo desarrollador en windows|modo desarrollador en tu teléfono",
        "pt": "modo desenvolvedor do windows|modo desenvolvedor no windows|modo desenvolvedor no seu telefone",
    },
    "secret": {
        "en": "system message of the day|secret key of your account|secret key in the environment",
        "es": "clave secreta de tu cuenta",
        "pt": "chave secreta da sua conta",
    },
    "document": {
        "en": "the document root|the document element|the document object",
        "es": "el documento raíz",
        "pt": "o documento raiz",
    },
}
#: What may stand right before the verb of an order that does not open its clause.
CUES = {
    "en": "please|kindly|also|and|then|now|always|must|should|you to|would you|could you|can you|will you|make sure to|be sure to|remember to|required to|instructed to",
    "es": "por favor|favor de|también|y|luego|ahora|siempre|debes|debe|podrías|puedes|quiero que|necesito que|le agradecería que|asegúrate de que",
    "pt": "por favor|favor|também|e|então|agora|sempre|deve|você deve|poderia|gostaria que|quero que|preciso que|peço que|certifique-se de que",
}


@dataclass(frozen=True)
class Family:
    category: str
    parts: tuple[str, ...]
    gap: int = 0  # at most so many words between two parts
    opens: bool = False  # the first part must open a clause or follow a cue
    mentions: bool = False  # it gives no order


#: Rules by name; each holds in all three languages.
FAMILIES = {
    "override": Family("override", ("cancel", "told"), 4),
    "override-passive": Family("override", ("told", "be_cancelled"), 3),
    "forget": Family("override", ("cancel", "all_before"), 1),
    "anew": Family("override", ("anew",)),
    "leak": Family("prompt_leak", ("reveal", "secret"), 3, mentions=True),
    "leak-passive": Family("prompt_leak", ("secret", "be_revealed"), 2, mentions=True),
    "leak-question": Family("prompt_leak", ("ask_secret",), mentions=True),
    "role": Family("role_hijack", ("become",), opens=True),
    "mode": Family("mode_switch", ("enter", "mode"), 2),
    "no-limits": Family("mode_switch", ("no_limits",)),
    "safety": Family("mode_switch", ("cancel", "safety"), 4),
    "reply-only": Family("output_hijack", ("reply", "only"), 1),
    "reply-plain": Family("output_hijack", ("reply", "plain"), 4),
    "reply-encoded": Family("output_hijack", ("reply", "encoded"), 4),
    "mark": Family("output_hijack", ("mark", "option", "as_right"), 3, opens=True),
    "mark-passive": Family("output_hijack", ("option", "be_right"), 3),
    "key": Family("output_hijack", ("key",)),
    "insert": Family("output_hijack", ("put", "token", "everywhere"), 6, opens=True),
    "insert-passive": Family("output_hijack", ("token", "be_put", "everywhere"), 4),
    "begin": Family("output_hijack", ("begin", "everywhere"), 2, opens=True),
    "begin-passive": Family("output_hijack", ("everywhere", "must_begin"), 2),
    "tongue": Family("output_hijack", ("write", "everywhere", "tongue"), 4, opens=True),
    "tongue-passive": Family("output_hijack", ("everywhere", "be_written", "tongue"), 3),
    "marks": Family("output_hijack", ("marks",), opens=True),
    "swap": Family("task_swap", ("swap",)),
    "document": Family("task_swap", ("cancel", "document"), 3, opens=True),
    "document-passive": Family("task_swap", ("document", "be_cancelled"), 2),
    "link": Family("exfiltration", ("put", "link", "everywhere"), 4, opens=True),
    "link-passive": Family("exfiltration", ("link", "be_put", "everywhere"), 4),
    "fetch": Family("exfiltration", ("fetch", "link"), 0, opens=True),
    "hush": Family("concealment", ("hush", "of_this"), 2),
    "authority": Family("authority", ("authority",)),
    "fence": Family("delimiter", ("fence",)),
}
LANGUAGES = ("en", "es", "pt")
MARKUP = re.compile(
    r"(?i)<\|(?:im_start|im_end|endoftext|system|user|assistant|eot_id|begin_of_text)\|>|\[/?INST\]|<</?SYS>>"
)
_WORD = re.compile(r"\w+")
_BLANKS = re.compile(r"[^\S\n]{2,}|[^\S\n ]")


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    lang: str
    parts: tuple[str, ...]
    gap: int
    opens: bool
    imperative: bool


RULES = tuple(
    Rule(f"{lang}-{name}", f.category, lang, f.parts, f.gap, f.opens, not f.mentions)
    for lang in LANGUAGES for name, f in FAMILIES.items()
)


def spellings(phrases: str) -> set[str]:
    """The phrases of a list, with their accents and without them."""
    bare = unicodedata.normalize("NFD", phrases)
    return {*phrases.split("|"), *"".join(c for c in bare if not unicodedata.combining(c)).split("|")}


@cache
def automaton() -> ahocorasick.Automaton:
    """Each phrase with its length and what it is: (harmless, class, language)."""
    meaning = defaultdict(list)
    for harmless, table in ((False, PHRASES), (True, HARMLESS)):
        for name, by_lang in table.items():
            for lang, phrases in by_lang.items():
                for p in spellings(phrases):
                    meaning[p].append((harmless, name, lang))
    made = ahocorasick.Automaton()
    for phrase, of in meaning.items():
        made.add_word(phrase, (len(phrase), of))
    made.make_automaton()
    return made


#: No cue is longer, with what tells where it begins.
LONGEST_CUE = 40


@cache
def cue(lang: str) -> re.Pattern[str]:
    """A cue of a language at the end of a text."""
    longest_first = sorted(spellings(CUES[lang]), key=len, reverse=True)
    return re.compile(rf"(?<![^\W_])(?:{'|'.join(map(re.escape, longest_first))})\Z")


@cache
def rules_by_part() -> dict[tuple[str, str], list[Rule]]:
    """The rules by language and last class: a rule can match only where that occurs."""
    out = defaultdict(list)
    for r in RULES:
        out[r.lang, r.parts[-1]].append(r)
    return out


@cache
def order() -> dict[str, int]:
    return {r.id: k for k, r in enumerate(RULES)}


def tidy(text: str) -> str:
    """Lower case, one blank for each run of blanks; lines stay."""
    low = text.lower()
    return _BLANKS.sub(" ", low) if _BLANKS.search(low) else low


class Line:
    """What the automaton has found in a line: where phrases of each class and language begin and end."""

    def __init__(self, text: str, found: list[tuple[int, int, list[tuple[bool, str, str]]]]) -> None:
        self.text, self.places, veto = text, defaultdict(list), defaultdict(list)
        for start, end, of in found:
            for harmless, name, lang in of:
                (veto if harmless else self.places)[lang, name].append((start, end))
        for key, spans in veto.items():
            self.places[key] = [p for p in self.places[key] if not any(a < p[1] and p[0] < b for a, b in spans)]
        self._starts: list[int] | None = None

    def words_between(self, end: int, start: int) -> int:
        if self._starts is None:
            self._starts = [m.start() for m in _WORD.finditer(self.text)]
        return bisect_left(self._starts, start) - bisect_left(self._starts, end)

    def opens(self, start: int, lang: str) -> bool:
        """Whether a clause begins there: nothing or a punctuation mark stands before, or a cue."""
        before = self.text[max(0, start - LONGEST_CUE) : start].rstrip()
        return not before or not (before[-1].isalnum() or before[-1] in "'’_") or bool(cue(lang).search(before))

    def holds(self, rule: Rule) -> bool:
        ends: list[int] = []
        for k, part in enumerate(rule.parts):
            spots = self.places.get((rule.lang, part), ())
            if k == 0:
                ends = [b for a, b in spots if not rule.opens or self.opens(a, rule.lang)]
            else:  # the nearest end before a place has the fewest words between
                ends.sort()
                near = [(a, b, bisect_right(ends, a)) for a, b in spots]
                ends = [b for a, b, i in near if i and self.words_between(ends[i - 1], a) <= rule.gap]
            if not ends:
                return False
        return True


def lines_with_phrases(text: str) -> list[tuple[int, Line]]:
    """Of a tidy text, the lines (by number) in which phrases of the grammar stand, as whole words."""
    found = defaultdict(list)
    breaks: list[int] | None = None
    for last, (size, of) in automaton().iter(text):
        start, end = last + 1 - size, last + 1
        if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum() and text[last].isalnum()):
            continue
        if breaks is None:
            breaks = [-1, *(m.start() for m in re.finditer("\n", text)), len(text)]
        k = bisect_left(breaks, start) - 1
        found[k].append((start - breaks[k] - 1, end - breaks[k] - 1, of))
    return [(k, Line(text[breaks[k] + 1 : breaks[k + 1]], f)) for k, f in sorted(found.items())]


def matching_by_line(text: str) -> list[tuple[int, Rule]]:
    """(line number, rule) of a text in lower case, raw or normalised, in the order of lines and rules."""
    out = []
    for k, line in lines_with_phrases(tidy(text)):
        candidates = {r.id: r for key in line.places for r in rules_by_part().get(key, ())}
        out += [(k, candidates[i]) for i in sorted(candidates, key=order().get) if line.holds(candidates[i])]
    return out


def matching(text: str) -> list[Rule]:
    """Rules that match a text (raw or normalised) taken as one line."""
    return list(dict.fromkeys(r for _, r in matching_by_line(text.replace("\n", " "))))
