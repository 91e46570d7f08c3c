"""Word lists and weights of the query language. Everything here is a fixed value:
results depend on these exact words and numbers."""

from __future__ import annotations

# Words that carry no meaning in a query or a record.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was will with this but they have "
    "had what said each which she how their if up out many then them these so some her would like into him time "
    "two go no way could my than first been call who oil sit now down day did get come made may part command commands"
).split()

# Stems that are put right.
STEM_FIXES = {
    "configur": "configure", "delet": "delete", "creat": "create", "remov": "remove", "modifi": "modify", "updat": "update", "generat": "generate",
    "locat": "locate", "runn": "run", "stopp": "stop", "mov": "move", "copi": "copy", "archiv": "archive",
}


def _lists(text: str) -> dict[str, list[str]]:
    """``word: first, second`` a line, to lists by word."""
    return {k.strip(): [w.strip() for w in v.split(",")] for k, v in (line.split(":") for line in text.strip().splitlines())}


# Synonyms, the best first.
SYNONYMS = _lists("""
file: document, data, content
files: documents, data, content
folder: directory, dir, path
folders: directories, dirs, paths
contents: content, data, text, inside
content: contents, data, text, inside
see: view, show, display, read, cat, less, more
view: see, show, display, read, cat, less, more
show: view, see, display, read, cat, less
display: view, see, show, read, cat, less
read: view, see, show, display, cat, less
look: view, see, show, display, cat
check: view, see, show, display, cat
print: cat, echo, printf, show
cat: view, show, display, less, more, head, tail
find: search, locate, discover, lookup
create: make, build, generate, new
delete: remove, destroy, erase, clean
copy: duplicate, clone, backup
move: relocate, transfer, shift
compress: zip, archive, pack, bundle, tar
extract: unzip, unpack, decompress, expand, tar -x
decompress: unzip, extract, unpack, expand, gunzip
unpack: unzip, extract, decompress, expand
unarchive: unzip, extract, untar, expand
download: fetch, get, pull, retrieve
upload: push, send, transfer, post
ip: network, interface, address, configuration, config
network: ip, interface, connection, config
interface: ip, network, adapter, config
process: task, job, service, daemon
processes: tasks, jobs, services
running: active, executing, live
kill: stop, terminate, end
start: run, launch, execute, begin
permission: permissions, access, rights, chmod
permissions: permission, access, rights, chmod
change: modify, alter, update, edit
compile: build, make, assemble
deploy: release, publish, ship
test: check, verify, validate
""")

# Verbs and the standard verbs they stand for.
ACTIONS = _lists("""
find: find, search, locate
search: find, search, locate
locate: find, search, locate
list: list, show, display
show: show, display, view
display: show, display, view
view: view, show, display
see: view, show, display
read: view, show, display
look: view, show, display
check: view, show, display
create: create, make, build
make: create, make, build
build: build, create, make
generate: create, make, build
new: create, make, build
edit: edit, modify, change
modify: edit, modify, change
change: edit, modify, change
update: update, modify, change
manage: manage, modify, configure, control
delete: delete, remove, destroy
remove: delete, remove, destroy
destroy: delete, remove, destroy
clean: clean, delete, remove
run: run, execute, start
execute: run, execute, start
start: start, run, execute
launch: start, run, execute
install: install, setup, add
setup: setup, install, configure
configure: configure, config, setup, set
config: configure, config, setup, set
add: add, install, setup
download: download, fetch, retrieve, save
fetch: download, fetch, retrieve
retrieve: download, fetch, retrieve
save: save, write, output
compress: compress, archive, zip, tar
extract: extract, unzip, unpack, tar
archive: archive, compress, zip, tar
pack: compress, archive, zip, tar
unpack: extract, unzip, unpack, tar
decompress: extract, unzip, decompress, gunzip
copy: copy, cp, duplicate
move: move, mv, relocate
rename: rename, mv, move
kill: kill, stop, terminate
stop: stop, kill, terminate
terminate: terminate, kill, stop
""")

# Nouns and the standard nouns they stand for.
TARGETS = _lists("""
file: file, document
files: files, documents
folder: directory, folder
directory: directory, folder
directories: directories, folders
path: path, location
contents: contents, content, data
content: content, contents, data
archive: archive, zip, tar
archives: archives, zip, tar
zip: zip, archive
tar: tar, archive
process: process, task
processes: processes, tasks
service: service, daemon
services: services, daemons
daemon: daemon, service
task: task, process
tasks: tasks, processes
server: server, host
port: port, socket
connection: connection, link
url: url, link, address
website: website, url, site
ip: network, interface, address
network: ip, interface, connection
interface: ip, network, adapter
project: project, repo, repository
repository: repository, repo
repo: repo, repository
branch: branch, ref
commit: commit, revision
code: code, source, program
permission: permission, permissions, access
permissions: permissions, permission, access
user: user, account
group: group, users
""")

# Intents in the order that settles ties.
INTENTS = "find create delete modify view run install configure general".split()

# What an action votes for, and how much.
ACTION_VOTES = [
    ("find", 1.0, "find search locate list".split()),
    ("view", 0.35, "show display view see read cat check".split()),
    ("create", 1.0, "create make build generate new".split()),
    ("delete", 1.0, "delete remove destroy clean clear".split()),
    ("modify", 1.0, "modify change edit update alter save".split()),
    ("install", 1.0, "install add download fetch retrieve".split()),
    ("run", 1.0, "run execute start launch kill stop terminate".split()),
    ("configure", 1.0, "configure config setup set".split()),
]

# What a keyword votes for; the first only where the query is about viewing.
KEYWORD_VOTES = [
    ("view", 0.4, "contents content inside text".split()),
    ("install", 0.6, "install installation download fetch url https http".split()),
    ("configure", 0.6, "config configuration setup".split()),
    ("find", 0.4, "running execution processes".split()),
    ("modify", 0.4, "permissions permission chmod".split()),
]
VIEW_ACTIONS = "view show see read display".split()
CLEAR_ACTIONS = "clear empty delete remove".split()
VIEW_HINTS = "see view show display read look".split()
CLOSED_HINTS = ["without opening", "without editing"]

# Keywords that an intent adds to a query with few others.
INTENT_KEYWORDS = {
    "find": ["search", "find"], "view": ["cat", "view", "show"], "create": ["create", "make"],
    "delete": ["delete", "remove"], "install": ["install", "setup"], "modify": ["configure", "change"],
}

# Words of a record that agree with an intent.
INTENT_EVIDENCE = {
    "view": "show display list view cat less".split(),
    "delete": "delete remove rm uninstall".split(),
    "create": "create make new mkdir touch".split(),
    "install": "install setup add download fetch curl wget".split(),
    "modify": "modify change edit update undo revert reset".split(),
}

# Term classes of long queries.
GENERIC_VERBS = "find search show check list get".split()
ENTITIES = "kb mb gb tb tar gz zip port process".split()
LOW_SIGNAL_TERMS = "me current project every each custom name under sorted should which matching lines".split()
LOW_SIGNAL_TARGETS = "directory directories folder folders path location content contents".split()
ANCHORS = "download upload url http https port process disk usage replace archive compress extract revert undo windows linux macos grep search".split()

# Cues that make out the intent of a long query, and the words that speak for and against a record then.
LONG_INTENTS = [
    ("download", "download fetch url http https file save wget curl".split(), "download fetch url http https wget curl save output".split(), "tree set-location cd realpath path directory".split()),
    ("disk", "disk usage folder directory size sorted space du df".split(), "disk usage du df size space folder directory sort sorted".split(), "tree set-location cd realpath path root".split()),
    ("recursive_text", "recursive recursively text files file timeout error grep search find replace json".split(), "grep ripgrep rg find recursive recursively pattern regex search replace sed awk perl".split(), "conda npm gh pdf tree repo project".split()),
    ("process_port", "process port listening listen socket windows 8080 netstat lsof ss".split(), "netstat ss lsof port socket listening process pid taskkill".split(), "find tree package manager macports".split()),
]

# Commands that belong to a word's domain.
DOMAINS = _lists("""
compress: tar, gzip, zip, bzip, 7z, compress, archive
archive: tar, gzip, zip, bzip, 7z, compress, archive, unzip
extract: tar, unzip, gunzip, extract, unarchive
directory: mkdir, rmdir, ls, dir, cd, pwd
folder: mkdir, rmdir, ls, dir, cd, pwd
create: mkdir, touch, make, new
file: cp, mv, rm, touch, cat, less, more
search: grep, find, locate, ag, rg
download: wget, curl, fetch, download
git: git, clone, commit, push, pull, branch
package: apt, yum, dnf, pkg, brew, pip, npm
process: ps, kill, top, htop, jobs
network: ping, ssh, scp, rsync, nc, nmap
edit: vim, nano, emacs, edit, sed, awk
permission: chmod, chown, chgrp, sudo
new: mkdir, touch, create, make
""")

# Tools that run everywhere.
CROSS_PLATFORM_TOOLS = (
    "git docker node npm yarn python pip go cargo rustc java javac mvn gradle curl wget ssh scp rsync mv cp rm ls cat grep find sed awk "
    "code vim nano tar gzip unzip zip 7z ffmpeg imagemagick convert heroku aws gcloud az kubectl helm terraform ansible vagrant "
    "composer php ruby gem bundle rails dotnet nuget flutter dart ionic cordova electron ng vue react create-react-app webpack babel "
    "eslint prettier jest mocha cypress playwright selenium"
).split()

# Words that are never suggested.
COMMON_WORDS = (
    "the a an and or but in on at to for of with by is are was were be been have has had do does did will would could should this that these "
    "those it its you your all any can from not no if when where how what which who why use used using file files directory directories"
).split()

# Words that pages and examples do not contribute.
PAGE_STOP_WORDS = "the a an and or to for of in on with from into by at is are be this that as using use via over under all any more information see also about through without across".split()
PAGE_PLATFORMS = {
    "common": ["linux", "macos", "windows"], "linux": ["linux"], "osx": ["macos"], "windows": ["windows"], "android": ["android"],
    "sunos": ["linux"], "freebsd": ["linux"], "netbsd": ["linux"], "openbsd": ["linux"],
}

# Terms that a project of a type raises.
PROJECT_BOOSTS = {
    "git": {"git": 2.0, "commit": 1.5, "branch": 1.5, "merge": 1.5, "pull": 1.5, "push": 1.5, "clone": 1.5, "checkout": 1.5},
    "docker": {"docker": 2.0, "container": 1.8, "image": 1.5, "build": 1.3, "run": 1.3, "compose": 1.5},
    "node": {"npm": 2.0, "yarn": 2.0, "node": 1.8, "javascript": 1.5, "package": 1.3, "install": 1.3},
    "python": {"python": 2.0, "pip": 2.0, "virtual": 1.5, "venv": 1.5, "conda": 1.5, "requirements": 1.3},
    "go": {"go": 2.0, "mod": 1.8, "build": 1.5, "test": 1.5, "run": 1.3},
    "rust": {"cargo": 2.0, "rust": 1.8, "build": 1.5, "test": 1.5},
    "java": {"java": 2.0, "maven": 1.8, "gradle": 1.8, "build": 1.5, "compile": 1.5},
    "dotnet": {"dotnet": 2.0, "nuget": 1.8, "build": 1.5, "restore": 1.5},
    "ruby": {"ruby": 2.0, "gem": 1.8, "bundle": 1.5, "rake": 1.5},
    "php": {"php": 2.0, "composer": 1.8, "artisan": 1.5, "laravel": 1.3},
    "c": {"gcc": 2.0, "make": 1.8, "cmake": 1.8, "compile": 1.5, "build": 1.5},
    "cpp": {"gcc": 2.0, "make": 1.8, "cmake": 1.8, "compile": 1.5, "build": 1.5},
    "kubernetes": {"kubectl": 2.0, "kubernetes": 1.8, "k8s": 1.8, "pod": 1.5, "service": 1.3, "deploy": 1.3},
    "terraform": {"terraform": 2.0, "plan": 1.8, "apply": 1.8, "destroy": 1.5, "init": 1.5},
    "ansible": {"ansible": 2.0, "playbook": 1.8, "inventory": 1.5, "vault": 1.5},
    "webpack": {"webpack": 2.0, "build": 1.5, "bundle": 1.5},
    "vite": {"vite": 2.0, "build": 1.5, "dev": 1.5},
    "make": {"make": 2.0, "build": 1.5},
}

# File names (or patterns) that make out a project's type, language and build system, in the order of the checks.
PROJECT_FILES = [
    ("git", r"^\.git$", None, None),
    ("docker", r"^(Dockerfile|docker-compose\.yml|docker-compose\.yaml)$", None, None),
    ("node", r"^(package\.json|node_modules|yarn\.lock|pnpm-lock\.yaml)$", "javascript", None),
    ("webpack", r"^webpack\.config\.(js|ts)$", None, None),
    ("vite", r"^vite\.config\.(js|ts)$", None, None),
    ("python", r"^(requirements\.txt|setup\.py|pyproject\.toml|Pipfile)$", "python", None),
    ("go", r"^(go\.mod|go\.sum)$", "go", None),
    ("rust", r"^(Cargo\.toml|Cargo\.lock)$", "rust", None),
    ("java", r"^pom\.xml$", "java", "maven"),
    ("java", r"^(build\.gradle|build\.gradle\.kts)$", "java", "gradle"),
    ("dotnet", r"\.(csproj|vbproj|fsproj)$", "csharp", None),
    ("dotnet", r"^(global\.json|nuget\.config)$", None, None),
    ("ruby", r"^(Gemfile|Rakefile)$", "ruby", None),
    ("php", r"^(composer\.json|composer\.lock)$", "php", None),
    ("c", r"^CMakeLists\.txt$", "c", "cmake"),
    ("make", r"^(Makefile|makefile)$", None, None),
    ("kubernetes", r"(k8s|kubernetes).*\.(yaml|yml)$", None, None),
    ("kubernetes", r"^kustomization\.(yaml|yml)$", None, None),
    ("terraform", r"\.(tf|tfvars)$", None, None),
    ("ansible", r"^(ansible\.cfg|hosts|inventory)$", None, None),
    ("ansible", r"playbook.*\.(yml|yaml)$", None, None),
]
