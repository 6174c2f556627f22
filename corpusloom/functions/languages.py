"""File types, loaders and code separators known to the chunker."""

from __future__ import annotations

# Extension -> language of the code splitter.
LANGUAGE_OF = {
    ".py": "python", ".js": "js", ".jsx": "js", ".ts": "ts", ".tsx": "ts", ".java": "java", ".go": "go",
    ".rs": "rust", ".rb": "ruby", ".cs": "csharp", ".scala": "scala", ".swift": "swift", ".kt": "kotlin",
    ".php": "php", ".lua": "lua", ".hs": "haskell", ".c": "c", ".cpp": "cpp", ".h": "cpp", ".latex": "latex",
}

TEXT_EXTENSIONS = (*LANGUAGE_OF, ".md", ".txt")
HTML_EXTENSIONS = (".html", ".htm")
OFFICE_EXTENSIONS = (".pdf", ".docx", ".xlsx", ".pptx")
SUPPORTED_EXTENSIONS = (*TEXT_EXTENSIONS, *HTML_EXTENSIONS, *OFFICE_EXTENSIONS)

# Words that open a block in each language; a separator is a line end, the word and a blank.
BLOCK_WORDS = {
    "python": "class def",
    "js": "function const let var class if for while switch case default",
    "ts": "enum interface namespace type class function const let var if for while switch case default",
    "java": "class public protected private static if for while switch case",
    "go": "func var const type if for switch case",
    "rust": "fn const let if while for loop match const",
    "ruby": "def class if unless while for do begin rescue",
    "csharp": "interface enum implements delegate event class abstract public protected private static return if "
    "continue for foreach while switch break case else try throw finally catch",
    "scala": "class object def val var if for while match case",
    "swift": "func class struct enum if for while do switch case",
    "kotlin": "class public protected private internal companion fun val var if for while when else",
    "php": "function class if foreach while do switch case",
    "lua": "local function if for while repeat",
    "haskell": "main let in do where data newtype type module import class instance case",
    "c": "class void int float double if for while switch case",
    "cpp": "class void int float double if for while switch case",
}
LATEX_BLOCKS = ("chapter", "section", "subsection", "subsubsection")
LATEX_ENVIRONMENTS = ("enumerate", "itemize", "description", "list", "quote", "quotation", "verse", "verbatim", "align")


def separators(language: str | None) -> list[str]:
    """Coarse-to-fine separators of a language; the general list for none."""
    general = ["\n\n", "\n", " ", ""]
    if language == "latex":
        blocks = [f"\n\\{name}{{" for name in LATEX_BLOCKS] + [f"\n\\begin{{{name}}}" for name in LATEX_ENVIRONMENTS]
        return blocks + general
    words = BLOCK_WORDS.get(language or "", "").split()
    blocks = [f"\n{word} " for word in words]
    if language == "python":
        blocks.append("\n\tdef ")
    return blocks + general
