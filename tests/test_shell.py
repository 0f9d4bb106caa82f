"""The shell grammar, case by case."""

import pytest

from runweave.functions import shell


def names(text):
    return [c.name for c in shell.commands(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []),
        (None, []),
        ("ls -l", ["ls"]),
        ("cd /data && cat a b | wc -l; echo 'a; b' || true", ["cd", "cat", "wc", "echo", "true"]),
        ("x=$(curl u | jq .)", ["curl", "jq"]),
        ("$(ls | head -1)", ["ls", "head"]),
        ('grep -n "x|y" $(ls | head -1) | sort | uniq -c', ["grep", "ls", "head", "sort", "uniq"]),
        ('echo "$(date; echo $(whoami))"', ["echo", "date", "echo", "whoami"]),
        ("echo '$(date)'", ["echo"]),
        ("echo `basename \\`pwd\\``", ["echo", "basename", "pwd"]),
        ("echo $((1 + $(nproc)))", ["echo", "nproc"]),
        ("echo ${x:-$(id)}", ["echo", "id"]),
        ("for f in $(ls *.txt); do cat $f; done > all.txt", ["ls", "cat"]),
        ("while read l; do echo $l; done < in.txt", ["read", "echo"]),
        ("if grep -q x f; then echo yes; elif test -f g; then rm g; else exit 1; fi", ["grep", "echo", "test", "rm", "exit"]),
        ('case "$1" in a|b) start x;; c) stop; esac; end', ["start", "stop", "end"]),
        ("case $x in a) case $y in b) one;; esac;; *) two;; esac", ["one", "two"]),
        ("(cd x; make) && { ls; pwd; }", ["cd", "make", "ls", "pwd"]),
        ("f() { inner; }; f", ["inner", "f"]),
        ("function g { inner; }\ng", ["inner", "g"]),
        ("A=1 B='x y' /usr/bin/python3 run.py", ["python3"]),
        ("sudo -E env X=1 apt install y", ["apt"]),
        ("! time make", ["make"]),
        ("diff <(sort a) <(sort b)", ["diff", "sort", "sort"]),
        ("a 2>&1 | b >& log & c &> all", ["a", "b", "c"]),
        ("echo one # remark; rm x\nls", ["echo", "ls"]),
        ("echo a\\;b \\\n c", ["echo"]),
        ("a |\n b &&\n c", ["a", "b", "c"]),
        ("cat <<EOF > out.txt\nls; rm x\nEOF\ncat out.txt", ["cat", "cat"]),
        ("cat <<EOF\n$(hostname) \\$(no)\nEOF", ["cat", "hostname"]),
        ("cat <<'EOF'\n$(hostname)\nEOF", ["cat"]),
        ("cat <<-A <<B | wc\n\tone\n\tA\ntwo\nB\necho x", ["cat", "wc", "echo"]),
        ("tr a b <<< 'x; y'", ["tr"]),
        ("echo 'open; ls", ["echo"]),
        ("echo $(open", ["echo", "open"]),
        ("x=1", []),
        ("> empty.txt", []),
        (") | ; ls", ["ls"]),
    ],
)
def test_programs(text, want):
    assert names(text) == want


def test_nesting_to_any_depth():
    assert names("echo " + "$(a " * 60 + "x" + ")" * 60) == ["echo", *["a"] * 60]


def test_pipes_targets_and_bodies():
    a, b, c = shell.commands("cat > f.py <<'E'\nimport os\nprint(1)\nE\npython f.py 2>err | tee -a log >> out")
    assert (a.heredoc, a.target, a.reads, a.writes) == ("import os\nprint(1)", "f.py", False, False)
    assert (b.texts, b.target, b.reads, b.writes) == (["python", "f.py"], None, False, True)
    assert (c.texts, c.target, c.reads, c.writes) == (["tee", "-a", "log"], "out", True, False)
    assert [(x.name, x.depth) for x in shell.commands("a $(b $(c)); (d)")] == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]
    x, y = shell.commands("echo a | (sort; uniq)")[:2]
    assert x.writes and y.reads
    assert shell.commands('python -c "import os; print(\\"x\\")"')[0].texts == ["python", "-c", 'import os; print("x")']


def test_garbage_ends():
    import random

    rng = random.Random(4)
    for _ in range(3_000):
        text = "".join(rng.choice("ab $(){}`'\"\\;&|<>\n#=!case esac in for do") for _ in range(rng.randrange(40)))
        shell.commands.__wrapped__(text)
