"""Prompt and answer pairs with known defects, made of sentences in several languages."""

import random

SENTENCES = {
    "en": ("The {a} of the {b} was {c} by the group in the spring.", "Neither the {a} nor the {b} had been {c} before the second round.", "We have {c} the {a} with a larger {b} because the first one was lost.", "Each {a} in the {b} is {c} again when the season ends."),
    "de": ("Der {a} von dem {b} wurde im Frühling von der Gruppe {c}.", "Weder der {a} noch der {b} war vor dem zweiten Lauf {c}.", "Wir haben den {a} mit einem größeren {b} {c}, weil der erste verloren ging.", "Jede {a} aus dem {b} ist nach dem Ende der Saison wieder {c}."),
    "fr": ("Le {a} de la {b} a été {c} par le groupe au printemps.", "Ni le {a} ni la {b} n'avaient été {c} avant le second tour.", "Nous avons {c} le {a} avec une plus grande {b} dans la première région.", "Chaque {a} dans les {b} est {c} à nouveau après la saison."),
    "es": ("El {a} de la {b} fue {c} por el grupo en la primavera.", "Ni el {a} ni la {b} habían sido {c} antes de la segunda ronda.", "Hemos {c} el {a} con una {b} mayor porque la primera se perdió.", "Cada {a} en los {b} es {c} de nuevo tras la temporada."),
    "nl": ("De {a} van het {b} werd in het voorjaar door de groep {c}.", "Noch de {a} noch het {b} was vóór de tweede ronde {c}.", "Wij hebben de {a} met een groter {b} {c} omdat de eerste verloren ging.", "Elke {a} uit het {b} wordt na het seizoen opnieuw {c}."),
    "it": ("Il {a} della {b} è stato {c} dal gruppo nella primavera.", "Né il {a} né la {b} erano stati {c} prima del secondo giro.", "Abbiamo {c} il {a} con una {b} maggiore perché la prima andò persa.", "Ogni {a} nella {b} viene {c} di nuovo alla fine della stagione."),
    "sv": ("Den {a} från {b} blev under våren {c} av gruppen.", "Varken {a} eller {b} hade före andra omgången {c}.", "Vi har {c} {a} med en större {b} eftersom den första gick förlorad.", "Varje {a} i {b} blir åter {c} när säsongen tar slut."),
}
#: What prompts also speak of, so that a language is more than the words of one topic.
GENERAL = {
    "en": ("They said that nothing in this passage could be summarised without help.", "I am sorry to report that the request was not answered.", "It is unable to grow where the water stands, but I cannot say why.", "Some of us were afraid that the text would not be read."),
    "de": ("Sie sagten, dass nichts in diesem Text ohne Hilfe zusammengefasst werden kann.", "Es tut uns leid, dass die Anfrage nicht beantwortet wurde.", "Leider wächst es nicht, wo das Wasser steht, und ich kann nicht sagen, warum.", "Einige von uns fürchteten, dass man den Text nicht liest."),
    "fr": ("Ils ont dit que rien dans ce passage ne peut être résumé sans aide.", "Je regrette que la demande soit restée sans réponse.", "Elle n'est pas en mesure de pousser où l'eau reste, mais je ne sais pas pourquoi.", "Certains de nous étaient désolés de ne pas répondre au texte."),
    "es": ("Dijeron que nada en este pasaje se puede resumir sin ayuda.", "Lo siento, pero la petición no fue respondida.", "Lamentablemente no es posible crecer donde queda el agua, y no puedo decir por qué.", "Algunos de nosotros temían que no se leyera el texto."),
}
WORDS = {
    "en": ("harbour census record village fishery archive station catch".split(), "counted measured repeated extended confirmed reported".split()),
    "de": ("Hafen Bericht Bestand Fischfang Archiv Bahnhof Küstenort Fang".split(), "gezählt gemessen wiederholt erweitert bestätigt gemeldet".split()),
    "fr": ("port recensement registre village pêche archive station prise".split(), "compté mesuré répété étendu confirmé signalé".split()),
    "es": ("puerto censo registro pueblo pesca archivo estación captura".split(), "contado medido repetido ampliado confirmado referido".split()),
    "nl": ("haven telling verslag dorp visserij archief station vangst".split(), "geteld gemeten herhaald uitgebreid bevestigd gemeld".split()),
    "it": ("porto censimento registro villaggio pesca archivio stazione cattura".split(), "contato misurato ripetuto esteso confermato riferito".split()),
    "sv": ("hamnen räkningen protokollet byn fisket arkivet stationen fångsten".split(), "räknats mätts upprepats utvidgats bekräftats rapporterats".split()),
}
REFUSALS = {
    "en": ("I'm sorry, but I cannot summarise this passage.", "I am unable to help with this request."), "de": ("Es tut mir leid, ich kann diesen Text nicht zusammenfassen.", "Leider kann ich diese Anfrage nicht beantworten."),
    "fr": ("Désolé, je ne peux pas résumer ce passage.", "Je regrette, je ne suis pas en mesure de répondre."), "es": ("Lo siento, no puedo resumir este pasaje.", "Lamentablemente no es posible responder a esta petición."),
}
EMPTY = (None, "", "  ", "N/A", "…", "-", "(none)", "TBD")


def text(rng, lang, n):
    nouns, verbs = WORDS[lang]
    return " ".join(rng.choice(SENTENCES[lang]).format(a=rng.choice(nouns), b=rng.choice(nouns), c=rng.choice(verbs)) for _ in range(n))


def pairs(n, seed, answers=("en", "de", "fr", "es"), share=0.15):
    """[(prompt, answer, defect or None)]: prompts in four languages, wrong answers in ``answers``."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lang = rng.choice(("en", "de", "fr", "es"))
        prompt, answer, defect = text(rng, lang, 4) + " " + rng.choice(GENERAL[lang]), text(rng, lang, 2), None
        if rng.random() < share:
            defect = rng.choice(("empty", "refusal", "copy", "truncated", "wrong_language"))
            if defect == "empty":
                answer = rng.choice(EMPTY)
            elif defect == "refusal":
                answer = rng.choice(REFUSALS[lang])
            elif defect == "copy":
                words = prompt.split()
                for _ in range(rng.randint(0, 2)):
                    words[rng.randrange(len(words))] = "however"
                answer = " ".join(words)
            elif defect == "truncated":
                answer = answer[:-rng.randint(4, len(answer) // 3)].rstrip(". ")
            else:
                answer = text(rng, rng.choice([x for x in answers if x != lang]), 2)
        out.append((prompt, answer, defect))
    return out
