"""Profile, keyword lists and parity switches.

Everything a rule reads is passed in as one of these objects; nothing inside
the library reads a clock, a file or an environment variable.  The defaults
are the example profile that the published rules ship with.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# The published example keyword lists, in their published order.
# The order matters where a reason names the first matching term.

TITLE_WEIGHTS = {
    "product designer": 20,
    "designer de produto": 16,
    "ux/ui designer": 16,
    "ux/ui": 16,
    "ui/ux": 16,
    "ux designer": 16,
    "designer ux": 16,
    "product design": 20,
    "ui designer": 10,
    "design system": 16,
    "design ops": 16,
    "designer": 4,
}

TITLE_EXCLUDED = (
    "grafico", "gráfico", "graphic", "motion", "3d", "industrial", "instrucional",
    "moda", "interiores", "textil", "têxtil", "embalagem", "sobrancelha", "unhas",
    "joias", "jóias", "impressao", "impressão", "projetista", "cad", "estampas",
    "banco de talentos", "cadastro reserva", "lash", "cilios", "cílios",
    "micropigmentacao", "micropigmentação", "estetica", "estética", "nail",
    "barbeiro", "maquiagem",
)

ROLE_EXCLUDED = (
    "software engineer", "frontend engineer", "front-end engineer",
    "backend engineer", "fullstack engineer", "full-stack engineer",
    "desenvolvedor", "developer", "engenheiro de software", "data scientist",
    "cientista de dados", "product manager", "gerente de produto", "recrutador",
    "recruiter", "advocate", "game designer", "editorial", "designer editorial",
    "sound designer", "level designer", "web designer", "visual designer",
    "designer visual", "social media", "production designer",
    "designer de producao", "designer de produção",
)

TALENT_POOL = (
    "banco de talentos", "cadastro reserva", "banco de curriculos",
    "banco de currículos", "talent pool", "candidatura espontanea",
    "candidatura espontânea", "nao ha vaga aberta", "não há vaga aberta",
)

EMPLOYER_EXCLUDED = ("v4 company", "prizma midia", "prizma mídia", "leverdemo-8")

INTERMEDIARIES = ("jobgether",)

MARKETING_FRAMING = (
    "assessoria de marketing", "agencia de marketing", "agência de marketing",
    "trafego pago", "tráfego pago", "e-mail marketing", "email marketing",
    "pecas graficas", "peças gráficas", "material grafico", "materiais graficos",
    "materiais gráficos", "campanhas de marketing", "geracao de demanda",
    "geração de demanda", "identidade visual da marca", "marketing e vendas",
)

ONSITE_IN_BODY = (
    "modalidade: presencial", "modelo: presencial", "trabalho presencial",
    "atuacao presencial", "regime presencial", "100% presencial",
    "modalidade presencial",
)

HYBRID_IN_BODY = (
    "modalidade: hibrido", "modalidade: híbrido", "modelo: hibrido",
    "modelo: híbrido", "regime hibrido", "regime híbrido",
)

JUNIOR_TERMS = (
    "junior", "júnior", " jr", "jr.", "estagio", "estágio", "estagiario",
    "estagiário", "intern", "trainee", "aprendiz", "assistente", "graduate",
    "early-career", "early career", "recem-formado", "recém-formado",
)

DOMAIN_HIGH = (
    "fintech", "credito", "crédito", "banking", "banco", "investimento", "cvm",
    "regulado", "seguros", "insurtech", "pagamentos", "financeira",
)

DOMAIN_MEDIUM = ("saas", "b2b", "plataforma", "marketplace", "startup")

DOMAIN_NEUTRAL = (
    "banco de horas", "banco de dados", "banco de talentos",
    "banco de curriculos", "seguros de vida como beneficio",
)

SIGNALS = (
    "design system", "design ops", "designops", "token", "discovery", "research",
    "pesquisa", "usabilidade", "usability", "figma", "b2b", "dashboard", "0 to 1",
    "do zero", "zero a um", "ia", "ai", "llm", "inteligencia artificial",
    "inteligência artificial",
)

SIGNAL_GROUPS = (
    ("design ops", "designops"),
    ("research", "pesquisa"),
    ("usabilidade", "usability"),
    ("0 to 1", "do zero", "zero a um"),
    ("ia", "ai", "inteligencia artificial", "inteligência artificial"),
)

ENGLISH_STRONG = (
    "fluent english", "advanced english", "ingles fluente", "inglês fluente",
    "ingles avancado", "inglês avançado", "english fluency", "c1", "c2",
)

ENGLISH_DESIRABLE = (
    "ingles intermediario", "inglês intermediário", "intermediate english",
    "ingles desejavel", "inglês desejável", "english is a plus",
)

AREA_ROLES = ("designer", "design")

# Which theme a posting touches, and the words that say so.
EMPHASIS_BUCKETS = {
    "design-system": ("design system", "component library", "token", "biblioteca de componentes", "componentizacao"),
    "research": ("research", "discovery", "usabilidade", "usability", "user testing", "entrevista", "pesquisa"),
    "design-ops": ("design ops", "designops", "processo", "documentacao", "handoff", "operacao de design"),
    "fintech": (
        "fintech", "credito", "regulado", "compliance", "banking", "banco", "investimento", "cvm",
        "seguro", "pagamento", "risco sacado", "supply chain finance", "emprestimo", "financiamento",
    ),
    "zero-a-um": ("0 to 1", "from scratch", "do zero", "early stage", "scale-up", "primeiros", "construir do zero"),
    "ia": ("ai", "ia", "ai-native", "prompt", "llm", "inteligencia artificial", "copilot", "generativa"),
    "b2b": ("b2b", "saas", "dashboard", "plataforma", "backoffice", "painel"),
    "metricas": ("conversao", "growth", "metrica", "data-driven", "orientado a dados", "resultado", "impacto"),
    "onboarding": ("onboarding", "cadastro", "ativacao", "signup"),
    "lideranca": ("lideranca", "lead", "po", "product owner", "stakeholder", "mentoria", "referencia tecnica"),
    "mobile": ("mobile", "app", "ios", "android", "aplicativo"),
}

# How direct a source's link is; the highest wins a merge, unknown sources get 5.
SOURCE_PRIORITY = {
    "Gupy": 10, "InHire": 10, "Ashby": 10, "Greenhouse": 10, "Workable": 10,
    "SmartRecruiters": 10, "Lever": 10, "LinkedIn (Apify)": 7, "Arc": 8,
    "Himalayas": 6, "Vagas Remotas": 5, "Remotive": 5, "UX Remote Talent": 5,
    "Remotar": 4, "Solta": 1,
}
DEFAULT_PRIORITY = 5

NATIONAL_SOURCES = ("Gupy", "Remotar", "InHire", "Vagas Remotas", "Coluna Tech", "Vagas UX")
INTERNATIONAL_SOURCES = (
    "Arc", "UX Remote Talent", "ATS internacional", "Himalayas", "UX Jobs", "Gringas (career-ops)",
)
SHARED_SOURCES = ("LinkedIn (Apify)",)

# Board columns in order, the extra status an agent may set, and the decided ones.
BOARD_STATUSES = ("Avaliar", "Aplicar", "Já apliquei", "Entrevista", "Cancelada")
BOARD_EXTRA = ("Aplicado por IA",)
BOARD_CONCLUDED = ("Já apliquei", "Entrevista", "Cancelada", "Aplicado por IA")
SNAPSHOT_STATUSES = BOARD_STATUSES + ("Aplicado por IA", "Revisar")
INITIAL_STATUS = "Avaliar"


@dataclass(frozen=True)
class Keywords:
    """The keyword lists that make the rules specific to one profession."""

    title_weights: dict = field(default_factory=lambda: dict(TITLE_WEIGHTS))
    title_excluded: tuple = TITLE_EXCLUDED
    role_excluded: tuple = ROLE_EXCLUDED
    talent_pool: tuple = TALENT_POOL
    employer_excluded: tuple = EMPLOYER_EXCLUDED
    intermediaries: tuple = INTERMEDIARIES
    marketing_framing: tuple = MARKETING_FRAMING
    onsite_in_body: tuple = ONSITE_IN_BODY
    hybrid_in_body: tuple = HYBRID_IN_BODY
    junior_terms: tuple = JUNIOR_TERMS
    domain_high: tuple = DOMAIN_HIGH
    domain_medium: tuple = DOMAIN_MEDIUM
    domain_neutral: tuple = DOMAIN_NEUTRAL
    signals: tuple = SIGNALS
    signal_groups: tuple = SIGNAL_GROUPS
    english_strong: tuple = ENGLISH_STRONG
    english_desirable: tuple = ENGLISH_DESIRABLE
    area_roles: tuple = AREA_ROLES
    emphasis_buckets: dict = field(default_factory=lambda: dict(EMPHASIS_BUCKETS))


@dataclass(frozen=True)
class Reach:
    """How far the rules look, in characters; None is the whole text.  The defaults are the published rules' (fixed values)."""

    talent_pool: int | None = 400
    marketing: int | None = 600
    model: int | None = 400
    city: int | None = 600
    seniority: int | None = 700
    named_place: int | None = 48


#: Every rule reads whole texts.
WHOLE_TEXTS = Reach(None, None, None, None, None, None)


@dataclass(frozen=True)
class Profile:
    """Thresholds, weights, exchange rates and market focus of one person."""

    discarded_levels: tuple = ("junior", "estagio", "trainee", "aprendiz")
    accepts_hybrid: bool = False
    accepts_onsite: bool = False
    city: str = ""
    unknown_model_passes: bool = True
    new_until: int = 7
    recent_until: int = 21
    stalled_until: int = 30
    stalled_min_score: int = 70
    salary_floor_brl: float = 8000.0
    fx: dict = field(default_factory=lambda: {"BRL": 1.0, "USD": 5.4, "EUR": 5.9})
    salary_reference_brl: float = 10000.0
    mid_level_above_reference: bool = True
    english_strong_discount: float = 4.0
    english_desirable_discount: float = 0.0
    title_max: int = 20
    signals_max: float = 15.0
    semantic_max: int = 40
    cap_unvalidated: int = 55
    cap_loose_source: int = 60
    brief_from: int = 75
    read_per_run: int = 25
    market_focus: str | None = None
    market_priority: str | None = None
    market_discount: float = 6.0
    sources_off: tuple = ()
    reach: Reach = Reach()


@dataclass(frozen=True)
class Parity:
    """Switches that restore a known defect of the published rules.

    Each default is the corrected reading; set the flag to get the older one.
    """

    # "International" counts as the junior term "intern" (no right boundary).
    junior_prefix: bool = False
    # "mesmo" reads as month and "plano" as year (no word boundary).
    loose_period: bool = False
    # "R$ 12000 por mes" is not read (a thousands separator is required).
    separator_required: bool = False
    # gh_jid is always dropped as tracking, even when it is the only job id.
    drop_gh_jid: bool = False


DEFAULT_PROFILE = Profile()
DEFAULT_KEYWORDS = Keywords()
DEFAULT_PARITY = Parity()
